"""Format-preserving pseudonyms: personal values in texts are replaced by keyed permutations within their own format.

Card numbers, phone numbers, IPv4 addresses, social security numbers and dates are validated and then permuted by a
Feistel network over the pair of numbers that they make up, so that each pseudonym is again a valid value of the same
format, equal values get equal pseudonyms in every document, and different values different ones. The letters and
digits of e-mail names, account numbers, keys, hardware addresses, long hexadecimal secrets, web tokens, private keys
and values assigned to names like ``password`` go through the same network on strings. Only DataFrame functions are used: the texts never leave the JVM and nothing is shuffled.

Repeated groups in the patterns are possessive or have a bounded count, so that no text, however long, makes the
matcher recurse deeply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgframe.llm.common import free_name, table

#: The key of the query and the pipeline; on real data pass a secret of your own.
KEY = "pseudonym-key-1"
ROUNDS = 8

#: Signs of an assigned secret.
_SIGN = r"[0-9A-Za-z+/=_~!@#$%^*\-]"
#: What stands between a name and the value assigned to it.
_ASSIGN = r"(?:=>|:=|[:=])\s{0,3}[\"']?"

#: What is looked for, in this order; each begins where no letter or digit precedes it.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++){0,30}\.\p{L}{2,}",
    "key": r"(?<![\p{L}\p{N}_\-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk)[_\-](?:live_|test_|proj-)?(?=[A-Za-z_\-]*[0-9])[0-9A-Za-z_\-]{20,200}|gh[opsu]_[0-9A-Za-z]{36,100}|xox[abprs]-(?=[A-Za-z\-]*[0-9])[0-9A-Za-z\-]{10,200}|AIza[0-9A-Za-z_\-]{35})(?![\p{L}\p{N}_\-])",
    "pem": r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----[^\-]*+(?:-(?!----)[^\-]*+)*+-----END (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----",
    "jwt": r"(?<![\p{L}\p{N}_\-.])eyJ[0-9A-Za-z_\-]{8,}+\.[0-9A-Za-z_\-]{8,}+\.[0-9A-Za-z_\-]{8,}+",
    "secret": r"(?<![\p{L}\p{N}])(?:(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,128}|(?=[0-9A-F]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,128})(?![\p{L}\p{N}])",
    "hardware": r"(?<![\p{L}\p{N}:\-])(?:(?:HH:){5}HH|(?:HH-){5}HH)(?![\p{L}\p{N}:\-])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:H{1,4}:){7}H{1,4}|(?:(?:H{1,4}:){2,6}|[fF][eE]80:)(?::H{1,4}){1,5}|::(?=[A-Fa-f:]{0,30}[0-9])H{1,4}(?::H{1,4}){0,6})(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{L}\p{N}.])(?<!(?i:version|release|build|section|chapter|clause|firmware)[ :=]{1,2})(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}\-])(?:\d{13,19}|\d{4}(?:-\d{4}){3}|\d{4}(?: \d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\p{L}\p{N}]|-\d)",
    "ssn": r"(?<![\p{L}\p{N}\-])(?:(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?!-\d)|(?<!\d )(?!000|666|9)\d{3} (?!00)\d\d (?!0000)\d{4}(?! ?\d|-\d))(?![\p{L}\p{N}])",
    "iso_date": r"(?<![\p{L}\p{N}\-])(?<!\d[/.])(?:19|20)\d\d(?:-MM-DD|/MM/DD|\.MM\.DD)END",
    "day_date": r"(?<![\p{L}\p{N}])(?<!\d[/.\-])(?:DD/MM/|DD\.MM\.|DD-MM-|MM/DD/|MM\.DD\.|MM-DD-)(?:19|20)\d\dEND",
    "brief_date": r"(?<![\p{L}\p{N}])(?<!\d[/.\-])(?:DD/MM/|MM/DD/|D2-M2-|M2-D2-)\d\dEND",
    "word_date": r"(?<![\p{L}\p{N}])(?:DD MONTH,? |MONTH DD,? )(?:19|20)\d\d(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-/]?|\d{3}[ .\-/])\d{3}[ .\-]?\d{4}(?![\p{L}\p{N}]|-\d)",
    "world_phone": r"(?<![\p{L}\p{N}])(?<!\d[/.,\-])(?:\+|00[ \-]?)[1-9](?:[ .\-/]?[()]?[ .\-/]?\d){6,14}(?![\p{L}\p{N}])",
    "trunk_phone": r"(?<![\p{L}\p{N}])(?<!\d[/.,\-])(?:0[1-9](?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4})|\(?0[1-9]\d{0,3}\)?[ \-/](?:\d{3,4}[ \-]\d{3,5}|\d{5,8})|0[1-9]\d{8,9})(?![\p{L}\p{N}]|[ .\-]\d)",
    "bare_phone": r"(?<![\p{L}\p{N}_#])(?<!\d[/.,\-])1?[2-9]\d{9}(?![\p{L}\p{N}_]|[/.,\-]\d)",
}
# The names of the months.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONTH = "(?:" + "|".join([rf"(?i:{m})" for m in MONTHS] + [rf"(?i:{m[:3]})\.?" for m in MONTHS]) + ")"
for _kind in ("hardware", "ipv6"):
    PATTERNS[_kind] = PATTERNS[_kind].replace("H", "[0-9A-Fa-f]")
PATTERNS["word_date"] = PATTERNS["word_date"].replace("MONTH", _MONTH).replace("DD", r"(?:0?[1-9]|[12]\d|3[01])")
#: Month, day, and what may follow a date: a time after T, but no other letter or digit.
for _kind in ("iso_date", "day_date", "brief_date"):
    PATTERNS[_kind] = PATTERNS[_kind].replace("M2", r"(?:0[1-9]|1[0-2])").replace("D2", r"(?:0[1-9]|[12]\d|3[01])").replace("MM", r"(?:0?[1-9]|1[0-2])").replace("DD", r"(?:0?[1-9]|[12]\d|3[01])").replace("END", r"(?!(?!T\d)[\p{L}\p{N}]|[/.\-]\d)")
# A value of 8 to 200 signs with a letter and a digit, which is no address and none of the other kinds, and no expression of a program.
_OTHER = "|".join(PATTERNS[k] for k in ("key", "secret", "jwt"))
PATTERNS["assigned"] = (
    r"(?i:passwo?r?d|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key)[0-9A-Za-z_\-]{0,40}+[\"']?\s{0,3}" + _ASSIGN
    + rf"(?!{_OTHER})(?![^\s@]{{1,100}}@[\p{{L}}\p{{N}}\-]{{1,60}}\.)(?=S{{0,200}}?[0-9])(?=S{{0,200}}?[A-Za-z])(?!=)S{{8,200}}+(?!S|[\p{{L}}\p{{N}}(\[]|\.[\p{{L}}\p{{N}}])".replace("S{", _SIGN + "{").replace("(?!S|", f"(?!{_SIGN}|")
)
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: All DAYS[0] * DAYS[1] = 73,049 days from FIRST_DAY to 2099-12-31, which the patterns accept, are permuted among themselves.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
#: The hundred years that years of two digits stand for.
BRIEF_YEARS = (1930, 2029)
#: Steps of a cycle walk; a step ends three walks of five, or three of ten where the year has two digits.
WALK = 200
#: Social security areas are 1 to 899 without 666.
AREAS, SERIALS = 898, 99 * 9999


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def keyed(key: str, kind: str, i: Column, x: Column) -> Column:
    """The round function: 60 bits of a keyed digest, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def permuted(left: Column, right: Column, a: int | Column, b: int | Column, key: str, kind: str) -> Column:
    """A permutation of Z_a x Z_b: rounds add, in turn, a digest of one number to the other. Gives struct(l, r)."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def turn(acc: Column, i: Column) -> Column:
        moved = F.pmod(acc["l"] + keyed(key, kind, i, acc["r"]), a)
        return let(moved, lambda l: F.struct(l.alias("l"), F.pmod(acc["r"] + keyed(key, kind, -i, l), b).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn)


def shifted(text: Column, digest: Column, hexadecimal: bool) -> Column:
    """Every letter and digit moved within its alphabet by its place's part of a digest; other characters stay."""

    def one(c: Column, j: Column) -> Column:
        h = F.conv(F.substring(digest, F.pmod(j, F.lit(20)) * 3 + 1, F.lit(3)), 16, 10).cast("int")
        code = F.ascii(c)
        if hexadecimal:
            digit = F.position(c, F.lit("0123456789abcdef")) - 1
            return F.when(digit >= 0, F.lower(F.hex(F.pmod(digit + h, F.lit(16)))).substr(-1, 1)).otherwise(c)
        moved = lambda first, n: F.char(F.lit(first) + F.pmod(code - F.lit(first) + h, F.lit(n)))
        return (
            F.when(code.between(48, 57), moved(48, 10)).when(code.between(97, 122), moved(97, 26)).when(code.between(65, 90), moved(65, 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def permuted_text(text: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """The network on strings: each half's characters are moved by digests of the other half, in turn."""
    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))

    def digest(i: Column, x: Column) -> Column:
        return F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), x), 256)

    def turn(acc: Column, i: Column) -> Column:
        moved = let(digest(i, acc["r"]), lambda h: shifted(acc["l"], h, hexadecimal))
        return let(moved, lambda l: F.struct(l.alias("l"), let(digest(-i, l), lambda h: shifted(acc["r"], h, hexadecimal)).alias("r")))

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn), lambda done: F.concat(done["l"], done["r"]))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counting once."""
    n = F.length(digits)

    def one(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), one)


def refilled(shape: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """``shape`` with its digits (or what ``kind`` matches) replaced, in turn, by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def one(acc: Column, c: Column) -> Column:
        is_digit = c.rlike(kind)
        return F.struct(
            F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + is_digit.cast("int")).alias("at")
        )

    return F.aggregate(F.split(shape, ""), start, one)["out"]


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the digit strings of one length (2 to 36)."""
    cut = F.floor(F.length(digits) / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), cut), F.substring(digits, cut + 1, F.length(digits))
    size = lambda s: F.pow(F.lit(10.0), F.length(s)).cast("long")
    done = permuted(left, right, size(left), size(right), key, kind)
    return let(done, lambda x: F.concat(F.lpad(x["l"].cast("string"), F.length(left), F.lit("0")), F.lpad(x["r"].cast("string"), F.length(right), F.lit("0"))))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def pseudonym_card(value: Column, key: str) -> Column:
    """A number that passes the Luhn check keeps its first digit and passes it again; others stay."""

    def changed(d: Column) -> Column:
        payload = F.concat(F.substring(d, 1, 1), let(F.substring(d, F.lit(2), F.length(d) - 2), lambda inner: permuted_digits(inner, key, "card")))
        checked = let(payload, lambda p: F.concat(p, let(F.concat(p, F.lit("0")), lambda q: F.pmod(-luhn_sum(q), F.lit(10)).cast("string"))))
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, let(checked, lambda c: refilled(value, c))).otherwise(value)

    return let(only_digits(value), changed)


def pseudonym_phone(value: Column, key: str) -> Column:
    """The digits after the country code or the trunk's 0 are permuted; other numbers have no more than the last ten changed."""
    is_trunk = value.rlike(f"^(?:{PATTERNS['trunk_phone']})$") & ~value.rlike(f"^(?:{PATTERNS['phone']})$")
    is_world = value.startswith("+") | value.rlike(f"^(?:{PATTERNS['world_phone']})$") & ~is_trunk

    def changed(d: Column) -> Column:
        exit_ = F.when(value.startswith("+"), 0).otherwise(2)
        code = exit_ + F.length(F.regexp_extract(F.substring(d, exit_ + 1, F.length(d)), COUNTRY, 0)) + value.contains("(0)").cast("int")
        kept = F.when(is_world, code).when(is_trunk, F.lit(1)).otherwise(F.length(d) - 10)
        rest = lambda n: let(F.substring(d, n + 1, F.length(d)), lambda x: permuted_digits(x, key, "phone"))
        return let(kept, lambda n: let(F.concat(F.substring(d, F.lit(1), n), rest(n)), lambda new: refilled(value, new)))

    return let(only_digits(value), changed)


def pseudonym_email(value: Column, key: str) -> Column:
    """The name is permuted as if in small letters and gets its capitals again, so addresses that differ in case stay linked."""
    at = F.instr(value, "@")
    name = F.substring(value, F.lit(1), at - 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    recased = lambda new: F.array_join(F.zip_with(F.split(name, ""), F.split(new, ""), lambda a, b: F.when(a.rlike("^[A-Z]$"), F.upper(b)).otherwise(b)), "")
    small = permuted_text(F.translate(name, capitals, capitals.lower()), key, "email")
    return F.concat(let(small, recased), F.substring(value, at, F.length(value)))


def permuted_hex(value: Column, key: str, kind: str) -> Column:
    """The network on hexadecimal digits; other signs stay. A value in capitals stays so, other values become small."""
    done = let(F.lower(value), lambda x: permuted_text(x, key, kind, hexadecimal=True))
    return F.when(value == F.upper(value), F.upper(done)).otherwise(done)


def mod97(text: Column) -> Column:
    """The remainder by 97 of a number whose capitals stand for 10 to 35."""

    def one(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, F.pmod(acc * 10 + code - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + code - 55, F.lit(97)))

    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(one(acc, c)))


def pseudonym_iban(value: Column, key: str) -> Column:
    """An account number whose check digits are right keeps its country and gets right ones again; others stay."""

    def changed(d: Column) -> Column:
        country, rest = F.substring(d, 1, 2), F.substring(d, F.lit(5), F.length(d))
        valid = mod97(F.concat(rest, F.substring(d, 1, 4))) == 1

        def checked(new: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            return refilled(value, F.concat(country, check, new), "[0-9A-Z]")

        return F.when(valid, let(permuted_text(rest, key, "iban"), checked)).otherwise(value)

    return let(F.replace(value, F.lit(" "), F.lit("")), changed)


def pseudonym_key(value: Column, key: str) -> Column:
    """What follows the prefix that tells the kind of key."""
    prefix = F.regexp_extract(value, r"^(?:AKIA|ASIA|AIza|(?:sk|pk|rk)[_\-](?:live_|test_|proj-)?|gh[opsu]_|xox[abprs]-)", 0)
    return let(prefix, lambda p: F.concat(p, let(F.substring(value, F.length(p) + 1, F.length(value)), lambda rest: permuted_text(rest, key, "key"))))


def pseudonym_jwt(value: Column, key: str) -> Column:
    """The header, which names the way of signing, stays; content and signature are permuted."""
    header = F.substring_index(value, ".", 1)
    return F.concat(header, let(F.substring(value, F.length(header) + 1, F.length(value)), lambda rest: permuted_text(rest, key, "jwt")))


def pseudonym_pem(value: Column, key: str) -> Column:
    """Each line of a private key, broken by line ends or by ``\\n`` as in JSON; the first, the last and those with a colon stay."""
    ends = r"(?:\r|\n|\\r|\\n)+|(?<=KEY-----)|(?=-----END)"
    lines = F.transform(F.split(value, ends, -1), lambda x: F.when(x.contains(":") | x.startswith("-----"), x).otherwise(permuted_text(x, key, "pem")))
    marks = F.concat(F.regexp_extract_all(value, F.lit(ends), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(lines, marks, lambda x, m: F.concat(x, F.coalesce(m, F.lit("")))), "")


def pseudonym_assigned(value: Column, key: str) -> Column:
    """The value after the sign of assignment."""
    name = F.regexp_extract(value, "^[^:=]*+" + _ASSIGN, 0)
    return let(name, lambda n: F.concat(n, let(F.substring(value, F.length(n) + 1, F.length(value)), lambda rest: permuted_text(rest, key, "assigned"))))


def pseudonym_ipv6(value: Column, key: str) -> Column:
    """Link-local addresses stay such."""
    local = F.regexp_extract(value, "^[fF][eE]80:", 0)
    return let(local, lambda p: F.concat(p, let(F.substring(value, F.length(p) + 1, F.length(value)), lambda rest: permuted_hex(rest, key, "ipv6"))))


def pseudonym_ip(value: Column, key: str) -> Column:
    part = lambda i: F.split(value, r"\.")[i].cast("int")
    done = permuted(part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536, key, "ip")
    return let(done, lambda x: F.concat_ws(".", *[y.cast("string") for h in ("l", "r") for y in (F.floor(x[h] / 256), F.pmod(x[h], F.lit(256)))]))


def pseudonym_ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.split(value, "[ -]")[i].cast("int") for i in range(3))
    done = permuted(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, AREAS, SERIALS, key, "ssn")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    mark = F.substring(value, 4, 1)
    return let(done, lambda x: F.concat(pad(x["l"] + 1 + (x["l"] > 664).cast("int"), 3), mark, pad(F.floor(x["r"] / 9999) + 1, 2), mark, pad(F.pmod(x["r"], F.lit(9999)) + 1, 4)))


def pseudonym_date(value: Column, key: str, iso: bool) -> Column:
    """A real date becomes another one, equal days the same in year-first and day-first formats. Days that no calendar has stay.

    A month comes first only where the second number is over 12; then the new day is over 12, too, so that it can be
    mistaken for no day-first date: the permutation is applied until that holds. A year of two digits is one of
    ``BRIEF_YEARS``; the permutation is then applied until the new one is, too. One-digit numbers stay without zeros.
    """
    one, two, three = (F.split(value, r"[/.\-]")[i] for i in range(3))
    swapped = F.lit(False) if iso else two.cast("int") > 12
    year, month, day = (one, two, three) if iso else (three, F.when(swapped, one).otherwise(two), F.when(swapped, two).otherwise(one))
    pad = lambda x: F.lpad(x, 2, "0")
    brief = F.length(year) == 2
    year = F.when(brief, F.concat(F.when(year.cast("int") >= BRIEF_YEARS[0] % 100, F.lit("19")).otherwise(F.lit("20")), year)).otherwise(year)
    date = F.try_to_date(F.concat_ws("-", year, pad(month), pad(day)), "yyyy-MM-dd")
    first = F.lit(FIRST_DAY).cast("date")
    mark = F.regexp_extract(value, r"[/.\-]", 0)
    short = value.rlike(r"(?<!\d)\d(?!\d)")

    def shown(new: Column) -> Column:
        m, d = (F.when(short, x.cast("string")).otherwise(pad(x.cast("string"))) for x in (F.month(new), F.day(new)))
        y = F.when(brief, F.substring(F.year(new).cast("string"), 3, 2)).otherwise(F.year(new).cast("string"))
        return F.concat(y, mark, m, mark, d) if iso else F.concat(F.when(swapped, m).otherwise(d), mark, F.when(swapped, d).otherwise(m), mark, y)

    def moved(n: Column) -> Column:
        return let(permuted(F.floor(n / DAYS[1]), F.pmod(n, F.lit(DAYS[1])), *DAYS, key, "date"), lambda x: (x["l"] * DAYS[1] + x["r"]).cast("int"))

    def walked(n: Column) -> Column:
        if iso:
            return moved(n)
        go_on = lambda at: swapped & (F.day(F.date_add(first, at)) <= 12) | brief & ~F.year(F.date_add(first, at)).between(*BRIEF_YEARS)
        return F.aggregate(F.sequence(F.lit(1), F.when(swapped | brief, WALK).otherwise(1)), moved(n), lambda at, _: F.when(go_on(at), moved(at)).otherwise(at))

    return let(F.datediff(date, first), lambda n: F.when(n.isNotNull(), let(F.date_add(first, walked(n)), shown)).otherwise(value))


def pseudonym_word_date(value: Column, key: str) -> Column:
    """As ``pseudonym_date`` for a month in words, whose length and case stay."""
    name, year = F.regexp_extract(value, r"\p{L}+", 0), F.substring(value, -4, 4)
    day = F.regexp_extract(value, r"(?<!\d)\d\d?(?!\d)", 0)
    month = F.array_position(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    first = F.lit(FIRST_DAY).cast("date")
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    def shown(new: Column) -> Column:
        whole = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(new))
        m = F.when(F.length(name) > 3, whole).otherwise(F.substring(whole, 1, 3))
        m = F.when(name == F.upper(name), F.upper(m)).when(name == F.lower(name), F.lower(m)).otherwise(m)
        d = F.day(new).cast("string")
        d = F.when(day.startswith("0"), F.lpad(d, 2, "0")).otherwise(d)
        swapped = value.rlike("^\\p{L}")
        mark, end = F.when(value.rlike(r"^\p{L}+\.| \p{L}+\."), ".").otherwise(""), F.regexp_extract(value, ",? (?=....$)", 0)
        return F.concat(F.when(swapped, F.concat(m, mark, F.lit(" "), d)).otherwise(F.concat(d, F.lit(" "), m, mark)), end, F.year(new).cast("string"))

    def moved(n: Column) -> Column:
        return let(permuted(F.floor(n / DAYS[1]), F.pmod(n, F.lit(DAYS[1])), *DAYS, key, "date"), lambda x: (x["l"] * DAYS[1] + x["r"]).cast("int"))

    return let(F.datediff(date, first), lambda n: F.when(n.isNotNull(), let(F.date_add(first, moved(n)), shown)).otherwise(value))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value that was found."""
    is_kind = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(is_kind("email"), pseudonym_email(value, key))
        .when(is_kind("key"), pseudonym_key(value, key))
        .when(is_kind("pem"), pseudonym_pem(value, key))
        .when(is_kind("jwt"), pseudonym_jwt(value, key))
        .when(is_kind("assigned"), pseudonym_assigned(value, key))
        .when(is_kind("secret"), permuted_hex(value, key, "secret"))
        .when(is_kind("hardware"), permuted_hex(value, key, "hardware"))
        .when(is_kind("ipv6"), pseudonym_ipv6(value, key))
        .when(is_kind("ip"), pseudonym_ip(value, key))
        .when(is_kind("iban"), pseudonym_iban(value, key))
        .when(is_kind("card"), pseudonym_card(value, key))
        .when(is_kind("ssn"), pseudonym_ssn(value, key))
        .when(is_kind("iso_date"), pseudonym_date(value, key, True))
        .when(is_kind("day_date") | is_kind("brief_date"), pseudonym_date(value, key, False))
        .when(is_kind("word_date"), pseudonym_word_date(value, key))
        .otherwise(pseudonym_phone(value, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = "n_replaced") -> DataFrame:
    """``docs`` with the personal values of ``text_col`` replaced under ``key``; ``found_col`` counts the values that changed.

    Numbers that fail their check (Luhn, mod 97, octets, calendar) and all other text stay as they are, byte for byte.
    Null and empty texts stay so and count 0; repeated rows stay repeated; an empty table gives an empty one. All other
    columns are kept, whatever their names; a column named like ``found_col`` is an error.
    """
    if found_col in docs.columns:
        raise ValueError(f"docs has a column {found_col}; name another found_col")
    hits_col, new_col, count_col = (free_name(docs, c) for c in ("hits", "pseudonyms", "changed"))
    text, none = F.col(f"`{text_col}`"), F.array().cast("array<string>")
    hits = F.when(text.rlike(r"[0-9]|@|eyJ|PRIVATE KEY-----"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)
    rows = docs.withColumn(hits_col, F.coalesce(hits, none))
    rows = rows.withColumn(new_col, F.transform(hits_col, lambda v: pseudonym(v, key)))
    changed = F.size(F.filter(F.zip_with(hits_col, new_col, lambda a, b: a != b), lambda x: x))
    pieces = F.zip_with(F.split(text, ANY, -1), F.concat(new_col, F.array(F.lit(""))), lambda gap, new: F.concat(gap, new))
    rows = rows.withColumn(count_col, changed).withColumn(text_col, F.when(F.size(hits_col) > 0, F.array_join(pieces, "")).otherwise(text))
    return rows.withColumnRenamed(count_col, found_col).drop(hits_col, new_col) if found_col else rows.drop(count_col, hits_col, new_col)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with pseudonyms: doc_id, text, n_replaced."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
