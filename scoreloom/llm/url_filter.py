"""URL filters: dated list entries as validity intervals, judged as of each fetch."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("domain", "host", "prefix")  # from the widest to the most specific
HOUR = 3600


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port or final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def url_keys(url: Column) -> Column:
    """The list keys that cover a URL: (kind, value, depth) of its domains, its host and its path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(F.split(host, r"\."), n - k + 1, k), ".").alias("value"), k.alias("depth")))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    steps = F.split(F.regexp_replace(path, r"^/|/$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(
        F.lit("prefix").alias("kind"),
        F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, k), "/")).alias("value"), k.alias("depth")))
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"), F.lit(0).alias("depth")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, exact, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of dated list entries (list, kind, value, verdict, active, since).

    ``since`` is in seconds. An entry holds until the next one of its list, kind and value; entries with active false
    only end the one before. Of entries of one moment, an active one wins, then the verdict that sorts
    first; the others never hold. Null ``since`` or value never holds.
    """
    known = entries.where("since IS NOT NULL AND value IS NOT NULL")
    key = ["list", "kind", "value"]
    once = known.groupBy(*key, "since").agg(F.min(F.struct((~F.col("active")).alias("off"), "verdict")).alias("e"))
    until = F.lead("since").over(Window.partitionBy(*key).orderBy("since"))  # the changes of one list entry
    return once.withColumn("until", until).where("NOT e.off").select(
        *key, F.col("e.verdict").alias("verdict"), "since", "until"
    )


def url_verdicts(captures: DataFrame, entries: DataFrame, slot: int = 24 * HOUR) -> DataFrame:
    """One row per capture (capture_id, url, fetched_at in seconds) with the entry that decides it.

    Every capture is joined with the entries active at its fetch for any of its domains, its host or
    its path prefixes. The join key is (kind, value, time slot): first the distinct slots in
    which a key was fetched at all are matched with the intervals that touch them, then captures meet only the intervals of
    their slot. A host with a third of all captures is thus spread over its slots, and in a slot the
    join can be split, since one side has a row per interval. The widest keys (top domains) are kept only if a list has them.

    Decision: the most specific kind wins (prefix, host, domain), then the longest value, then verdict and list by name.
    Defined results: no active entry, a null url or fetch time, or a url without a host give
    null verdict and 0 matches; repeated rows are judged one by one but rows that agree in id, url and time
    give one row each with equal results; entries see ``intervals``.
    Returns capture_id, url, fetched_at, host, verdict, list, kind, value, since, matches.
    """
    spans = intervals(entries)
    rows = captures.select("capture_id", "url", "fetched_at", host_of(F.col("url")).alias("host"))
    keyed = rows.where("fetched_at IS NOT NULL AND host IS NOT NULL").distinct().select(
        "capture_id", "url", "fetched_at", F.floor(F.col("fetched_at") / slot).alias("slot"), F.explode(url_keys(F.col("url"))).alias("k")
    ).select("capture_id", "url", "fetched_at", "slot", "k.kind", "k.value", "k.depth")
    slots = keyed.select("kind", "value", "slot").distinct()
    touching = slots.join(spans, ["kind", "value"]).where(
        (F.col("since") < (F.col("slot") + 1) * slot) & (F.col("until").isNull() | (F.col("until") > F.col("slot") * slot))
    )
    hits = keyed.join(touching, ["kind", "value", "slot"]).where(
        (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    )
    rank = F.element_at(F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(-k))]), F.col("kind"))
    decided = hits.groupBy("capture_id", "url", "fetched_at").agg(
        F.min(F.struct(rank.alias("rank"), (-F.col("depth")).alias("depth"), "verdict", "list", "kind", "value", "since")).alias("best"),
        F.count(F.lit(1)).alias("matches"),
    ).withColumnsRenamed({"capture_id": "c", "url": "u", "fetched_at": "f"})
    same = rows["capture_id"].eqNullSafe(decided["c"]) & (rows["url"] == decided["u"]) & (rows["fetched_at"] == decided["f"])
    return rows.join(decided, same, "left").select(
        "capture_id", "url", "fetched_at", "host", "best.verdict", "best.list", "best.kind", "best.value", "best.since",
        F.coalesce("matches", F.lit(0)).alias("matches"),
    )
