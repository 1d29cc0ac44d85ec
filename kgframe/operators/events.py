"""Events by type, place and month; topics of variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgframe.functions.scalars import magnitude, month_of
from kgframe.sources.shared import Rounds


def event_months(events: DataFrame) -> DataFrame:
    """event_type, place, month: the distinct months with events."""
    return events.select("event_type", "place", month_of(F.col("date")).alias("month")).distinct()


def event_ids(events: DataFrame, type_: str, month: str) -> DataFrame:
    """Distinct events of a type and month with their magnitude."""
    return events.filter((F.col("event_type") == type_) & (month_of(F.col("date")) == month)).select("event_id", "place", "date", "magnitude").distinct()


def keep_event(events: DataFrame, prop: str | None, unit: str, low: float, high: float) -> DataFrame:
    """Events whose property, without its unit, is a number from low to high; all where no property is given."""
    if not prop:
        return events
    number = F.trim(F.regexp_replace(prop, f"^{unit}", "")).try_cast("double")
    return events.filter(number.between(low, high))


def top_events(events: DataFrame, unit: str, n: int = 100, keys: list[str] = ["event_type", "place", "month"], ascending: bool = False) -> DataFrame:
    """Up to n events of each key by magnitude, then id."""
    m = magnitude(F.col("magnitude"), unit)
    rows = events.withColumn("month", month_of(F.col("date"))).withColumn("number", m)
    order = Window.partitionBy(*keys).orderBy(F.asc("number") if ascending else F.desc("number"), "event_id")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def event_collection(events: DataFrame) -> DataFrame:
    """event_id, places, dates (sorted), and the scalar members of props as a map: one row for each event."""
    props = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: v.isNotNull())
    return events.groupBy("event_id").agg(F.sort_array(F.collect_set("place")).alias("places"), F.sort_array(F.collect_set("date")).alias("dates"), F.max("props").alias("props")).withColumn("props", props)


def affected_places(place: str, types: DataFrame, closure: DataFrame) -> DataFrame:
    """place: all countries and basins for Earth, those inside for a continent, else the place itself."""
    wanted = types.filter(F.col("type").isin("Country", "OceanicBasin")).select("place").distinct()
    if place == "Earth":
        return wanted
    inside = wanted.join(closure.filter(F.col("ancestor") == place).select(F.col("child").alias("place")), "place", "left_semi")
    itself = types.sparkSession.createDataFrame([(place,)], "place string")
    is_continent = types.filter((F.col("place") == place) & (F.col("type") == "Continent")).select("place")
    return inside.unionByName(itself.join(is_continent, "place", "left_anti")).distinct()


def topic_members(lists: DataFrame, peer_groups: DataFrame) -> DataFrame:
    """topic, member, position: comma lists in order, peer groups expanded in place, first occurrence kept.

    lists: topic, members; peer_groups: group_id, members. A member that is named like a peer group (``svpg/``) but is
    none is dropped.
    """
    items = lists.select("topic", F.posexplode(F.split("members", ",")).alias("a", "item"))
    inner = peer_groups.select(F.col("group_id").alias("item"), F.posexplode(F.split("members", ",")).alias("b", "member"))
    rows = items.join(inner, "item", "left").filter(F.col("member").isNotNull() | ~F.col("item").startswith("svpg/"))
    rows = rows.select("topic", F.coalesce("member", "item").alias("member"), F.struct("a", F.coalesce("b", F.lit(0)).alias("b")).alias("at"))
    first = rows.groupBy("topic", "member").agg(F.min("at").alias("at"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("topic").orderBy("at"))).drop("at")


def prune_empty_topics(members: DataFrame) -> DataFrame:
    """topic, member without links to topics that reach no variable, however far below. Ids of topics begin with ``dc/topic/``."""
    is_topic = F.col("member").startswith("dc/topic/")
    rounds = Rounds("live-topics")
    last = rounds.add(members.filter(~is_topic).select("topic").distinct())
    while not last.isEmpty():
        above = members.join(last.select(F.col("topic").alias("member")), "member", "left_semi").select("topic").distinct()
        last = rounds.add(above.join(rounds.all(), "topic", "left_anti"))
    live = rounds.all()
    kept = members.join(live, "topic", "left_semi")
    return kept.filter(~is_topic).unionByName(kept.filter(is_topic).join(live.select(F.col("topic").alias("member")), "member", "left_semi").select(*kept.columns))


def topic_roots(members: DataFrame, default: str, most: int = 10) -> DataFrame:
    """topic: those that no topic has as a member; the default where there are more than ``most``."""
    roots = members.select("topic").distinct().join(members.select(F.col("member").alias("topic")), "topic", "left_anti")
    n = roots.agg(F.count("*").alias("n"))
    curated = roots.sparkSession.createDataFrame([(default,)], "topic string")
    return roots.crossJoin(F.broadcast(n)).filter(F.col("n") <= most).select("topic").unionByName(curated.crossJoin(F.broadcast(n)).filter(F.col("n") > most).select("topic"))  # n is one row


def expand_topic(members: DataFrame, topics: DataFrame, deep: bool = True) -> DataFrame:
    """topic, variable, position: immediate variables, or all below in depth-first order; cycles end a path.

    topics: column topic. A variable that is met more than once keeps its first place.
    """
    is_topic = F.col("member").startswith("dc/topic/")
    start = members.join(topics, "topic", "left_semi").select("topic", "member", F.array("position").alias("path"), F.array("topic").alias("seen"))
    rounds = Rounds("topic-paths")
    level = rounds.add(start)
    while deep and not level.isEmpty():
        below = members.select(F.col("topic").alias("via"), F.col("member").alias("next"), "position")
        down = level.filter(is_topic).filter(~F.array_contains("seen", F.col("member"))).join(below, F.col("member") == F.col("via"))
        level = rounds.add(down.select("topic", F.col("next").alias("member"), F.array_append("path", F.col("position")).alias("path"), F.array_append("seen", F.col("via")).alias("seen")))
    rows = rounds.all().filter(~is_topic).select("topic", F.col("member").alias("variable"), "path")
    first = rows.groupBy("topic", "variable").agg(F.min("path").alias("path"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("topic").orderBy("path"))).drop("path")
