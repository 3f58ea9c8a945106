"""Which requests may go out, when, and which responses are usable."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsight.functions import urls as U
from shelfsight.functions.text import contains_any
from shelfsight.operators.joins import unique
from shelfsight.session import materialized
from shelfsight.settings import DEFAULTS

# fixed values: texts that mark a challenge page
CHALLENGE_MARKERS = (
    "cf-chl-bypass", "cf_chl_opt", "checking your browser", "__cf_bm", "akamai bot manager",
    "incapsula incident", "please verify you are a human",
)
# fixed values: endings accepted as images when the content type says nothing
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp")
MAX_IMAGE_BYTES = 10 * 1024 * 1024


def ssrf_filter_literal(requests: DataFrame) -> DataFrame:
    """Requests whose scheme, host name and address literal are acceptable."""
    return requests.filter(U.literal_is_safe(F.col("url")))


def host_verdicts(resolved_ips: DataFrame) -> DataFrame:
    """Per host whether every parseable address is public. A zone after ``%`` does not change what an address is."""
    address = F.regexp_replace(F.lower("ip"), r"(?<=:[^%]{0,64})%.*$", "")
    return resolved_ips.groupBy("host").agg(
        F.bool_and(F.coalesce(U.ip_is_public(address), F.lit(True))).alias("all_public")
    )


def ssrf_filter_resolved(requests: DataFrame, resolved_ips: DataFrame) -> DataFrame:
    """The whole outbound guard: literal rules, then all resolved addresses public.

    A host name without addresses is refused; an address literal needs none.
    """
    checked = ssrf_filter_literal(requests).withColumn("_host", U.hostname(F.col("url")))
    verdicts = host_verdicts(resolved_ips).select(F.col("host").alias("_host"), "all_public")
    literal = U.ip_is_public(F.col("_host")).isNotNull()
    return checked.join(verdicts, "_host", "left").filter(literal | F.coalesce("all_public", F.lit(False))).drop(
        "_host", "all_public"
    )


def robots_gate(requests: DataFrame, rules: DataFrame, user_agent: str = DEFAULTS.user_agent) -> DataFrame:
    """Add ``allowed``: the first rule of the applicable entry whose path starts the request's path.

    The applicable entry is the first one naming the agent, else ``*``. A path
    meets its rules in an equi-join on those of its prefixes whose length some
    rule of the host has, so neither a host's rules nor its requests are ever
    gathered. Hosts without rules allow everything.
    """
    product = user_agent.split("/")[0].lower()
    everyone = F.col("agent") == "*"
    entry = (
        rules.filter(everyone | F.contains(F.lit(product), F.lower("agent")))
        .groupBy("host")
        .agg(F.min_by("agent", F.struct(everyone.cast("int"), "ord")).alias("agent"))
    )
    active = (
        rules.join(entry, ["host", "agent"])
        .groupBy("host", "path")
        .agg(F.min_by("allow", "ord").alias("_allow"), F.min("ord").alias("_ord"))
    )
    sizes = active.groupBy("host").agg(F.collect_set(F.length("path")).alias("_sizes"))
    path = F.col("_path")
    prefixes = F.transform(
        F.filter("_sizes", lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n)
    )
    asked = requests.select("url", U.netloc(F.col("url")).alias("host"), U.robots_path(F.col("url")).alias("_path")).distinct()
    verdicts = (
        asked.join(sizes, "host")
        .select("url", "host", F.explode(F.array_distinct(F.array_append(prefixes, F.lit("*")))).alias("path"))
        .join(active, ["host", "path"])
        .groupBy("url")
        # a disallow line without a path allows everything
        .agg(F.min_by(F.col("_allow") | (F.col("path") == ""), "_ord").alias("_verdict"))
    )
    return requests.join(unique(verdicts), "url", "left").withColumn("allowed", F.coalesce("_verdict", F.lit(True))).drop("_verdict")


def _paced(batches: Iterator[pd.DataFrame], d: float) -> Iterator[pd.DataFrame]:
    """Number ``k`` of each request within its host and running maximum ``m`` of arrival - d*k, over a sorted partition."""
    host = count = top = None
    for batch in batches:
        if not len(batch):
            continue
        run = (batch["host"] != batch["host"].shift()) & ~(batch["host"].isna() & batch["host"].shift().isna())
        run.iloc[0] = True
        run = run.cumsum()
        first = run == 1
        goes_on = host is not None and (batch["host"].iloc[0] == host[0] or (pd.isna(batch["host"].iloc[0]) and pd.isna(host[0])))
        k = batch.groupby(run).cumcount() + (first * count if goes_on else 0)
        m = (batch["arrival_s"] - k * d).groupby(run).cummax().groupby(run).ffill()
        if goes_on and not pd.isna(top):
            m = m.where(~first, m.fillna(top).clip(lower=top))
        host, count, top = [batch["host"].iloc[-1]], int(k.iloc[-1]) + 1, m.iloc[-1]
        yield batch.assign(k=k.astype("int64"), m=m.astype("float64"))


def politeness_schedule(requests: DataFrame, delay_seconds: float | None = DEFAULTS.request_delay_seconds) -> DataFrame:
    """Start time of each request, at least ``delay`` after the previous one on its host.

    The recurrence start_i = max(arrival_i, start_(i-1) + d) unrolls to
    d*i + max over j <= i of (arrival_j - d*j), a running maximum. It is a prefix
    scan over ranges of (host, arrival, id): every partition runs over its own
    rows, and the hosts that go on from an earlier partition, at most one each,
    get its count and maximum carried over. A host of any size is cut by its
    arrivals and ids, so no task depends on how requests spread over hosts.
    """
    d = float(delay_seconds or 2.0)
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "arrival_s", "request_id"]
    dealt = requests.select(*order).withColumn("arrival_s", F.col("arrival_s").cast("double"))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField("k", T.LongType()), T.StructField("m", T.DoubleType())])
    local = materialized(dealt.mapInPandas(lambda batches: _paced(batches, d), schema), "paced-requests")
    before = Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("host", "part").agg((F.max("k") + 1).alias("_n"), F.max("m").alias("_top"))
    carried = (
        totals.withColumn("_off", F.sum("_n").over(before))
        .withColumn("_peak", F.max(F.col("_top") - F.coalesce("_off", F.lit(0)) * F.lit(d)).over(before))
        .filter(F.col("_off").isNotNull())
        .select(F.col("host").alias("_host"), F.col("part").alias("_part"), "_off", "_peak")
    )
    # one row per partition at most
    shifted = local.join(F.broadcast(carried), (F.col("part") == F.col("_part")) & F.col("host").eqNullSafe(F.col("_host")), "left")
    off = F.coalesce("_off", F.lit(0))
    i = off + F.col("k")
    peak = F.greatest(F.col("m") - off * F.lit(d), F.col("_peak"))
    return shifted.select("request_id", "host", "arrival_s", i.cast("long").alias("seq"), (peak + i * F.lit(d)).alias("start_s"))


def page_gate(pages: DataFrame) -> DataFrame:
    """Usable pages: status 200, a body, an HTML content type, no challenge markers."""
    return pages.filter(
        (F.col("status") == 200)
        & (F.col("html") != "")
        & F.contains(F.lower("content_type"), F.lit("html"))
        & ~contains_any(F.lower("html"), CHALLENGE_MARKERS)
    )


def page_strip_noise(pages: DataFrame) -> DataFrame:
    """Remove script, style, noscript, svg and iframe elements with their content."""
    return pages.withColumn(
        "html", F.regexp_replace("html", r"(?is)<(script|style|noscript|svg|iframe)\b.*?</\1\s*>", "")
    )


def download_gate(downloads: DataFrame, max_bytes: int = MAX_IMAGE_BYTES) -> DataFrame:
    """Usable downloads with their ``mimetype``; an empty content type counts as JPEG."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    named = F.lit(False)
    for ending in IMAGE_ENDINGS:
        named = named | F.lower("url").endswith(ending)
    return downloads.filter(
        (F.col("status") == 200) & (kind.startswith("image/") | named) & (F.col("n_bytes") <= max_bytes)
    ).withColumn("mimetype", F.coalesce(F.nullif(kind, F.lit("")), F.lit("image/jpeg")))
