"""Registered queries: each maps a reference operation onto the test
tables.  ``QUERIES[name](spark, sf_dir) -> DataFrame``; the matching
DuckDB SQL is in :mod:`fleetframe.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.functions import text
from fleetframe.operators import inventory, keyed, lifecycle, nested, quality, sequences
from fleetframe.plans import derived, ordered
from fleetframe.sources import logs
from fleetframe.sources.tables import Tables, lookup_options
from fleetframe.streaming import stateful as streaming

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


# Fixed parameters of the registered queries.
CATALOG_DATACENTER = "AFRICA-dc0"


@query
def catalog_by_location(spark: SparkSession, base: str) -> DataFrame:
    """Parts priced at one location."""
    t = Tables(spark, base)
    columns = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
               "price_hourly_net", "price_hourly_gross", "price_monthly_net",
               "price_monthly_gross", "deprecated")
    location = nested.validate_datacenter(CATALOG_DATACENTER)
    return nested.server_types_at(derived.part_catalog(t, location), CATALOG_DATACENTER,
                                  columns=columns, sort=("p_type", "p_size", "p_partkey"))


@query
def catalog_all_locations(spark: SparkSession, base: str) -> DataFrame:
    """Every (part, data center) pair with a price there, from the long
    price table."""
    t = Tables(spark, base)
    part = t.part.select("p_partkey", "p_type", "p_size")
    prices = nested.priced_at_datacenters(derived.part_price_rows(t), derived.region_datacenters(t), "r_name")
    return (prices.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select("datacenter", "p_partkey", "p_type", "p_size",
                    F.col("hourly_net").alias("price_hourly_net"), F.col("hourly_gross").alias("price_hourly_gross"),
                    F.col("monthly_net").alias("price_monthly_net"), F.col("monthly_gross").alias("price_monthly_gross")))


@query
def datacenter_flatten(spark: SparkSession, base: str) -> DataFrame:
    """Nested data-center records flattened to 9 columns."""
    return nested.flatten_datacenters(derived.supplier_datacenters(Tables(spark, base)))


# --- projections -----------------------------------------------------------------

@query
def null_default(spark: SparkSession, base: str) -> DataFrame:
    """P5: documents with their labels; a missing ``toxic`` becomes 0."""
    t = Tables(spark, base)
    docs = t.documents.select("doc_id", "lang")
    labels = t.labels.select(F.col("doc_id").alias("l_doc_id"), "quality", "toxic")
    j = docs.join(labels, docs["doc_id"] == labels["l_doc_id"], "left").drop("l_doc_id")
    j = j.withColumn("toxic_defaulted", F.col("toxic").isNull())
    return nested.fill_default(j, "toxic", 0)


@query
def override_merge(spark: SparkSession, base: str) -> DataFrame:
    """Customers merged with per-nation overrides (null keeps the base;
    ``false`` and ``0`` override)."""
    t = Tables(spark, base)
    cust = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
                             (F.col("c_acctbal") > 0).alias("active"))
    rk = F.col("n_regionkey")
    overrides = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
                 .select(F.col("n_nationkey").alias("c_nationkey"),
                         F.when(rk != 0, F.col("r_name")).alias("c_mktsegment"),
                         F.when(rk == 3, F.lit(0.0)).alias("c_acctbal"),
                         F.when(rk == 1, F.lit(False)).when(rk == 2, F.lit(True)).alias("active")))
    return keyed.override_merge(cust, overrides, "c_nationkey", ["c_mktsegment", "c_acctbal", "active"])


@query
def access_report(spark: SparkSession, base: str) -> DataFrame:
    """Suppliers as workers of their nation's cluster, nations
    as schedulers carrying the dashboard port; one URL row per node."""
    t = Tables(spark, base)
    sup = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    nat = t.nation.select("n_nationkey", "n_name")
    ip = F.concat(F.lit("10."), F.col("s_nationkey").cast("string"), F.lit("."),
                  (F.col("s_suppkey") / 250).cast("bigint").cast("string"), F.lit("."),
                  (F.col("s_suppkey") % 250 + 1).cast("string"))
    workers = (sup.join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
               .select(F.col("n_name").alias("cluster"), F.col("s_name").alias("node"), ip.alias("ip")))
    schedulers = nat.select(
        F.col("n_name").alias("cluster"),
        F.concat(F.col("n_name"), F.lit("-node-scheduler")).alias("node"),
        F.concat(F.lit("10."), F.col("n_nationkey").cast("string"), F.lit(".255.254")).alias("ip"),
        (F.lit(9756) + F.col("n_nationkey")).alias("port"))
    return inventory.access_report(workers, schedulers, "cluster", "node", "ip", "port")


# --- filters -----------------------------------------------------------------------

WORKER_PREFIX = "Customer#0000001"
WORKER_MARKER = "5"
DELETE_PREFIXES = ("Brand#1", "Customer#00000000")


@query
def worker_filter(spark: SparkSession, base: str) -> DataFrame:
    """S3 F1: names with the cluster prefix that contain the worker marker."""
    cust = Tables(spark, base).customer.select("c_custkey", "c_name", "c_nationkey")
    return inventory.worker_filter(cust, WORKER_PREFIX, "c_name", WORKER_MARKER)


@query
def delete_plan(spark: SparkSession, base: str) -> DataFrame:
    """Four resource tables as one inventory, each row marked
    delete or keep."""
    t = Tables(spark, base)
    inv = inventory.union_inventory(
        {"customer": t.customer, "supplier": t.supplier, "part": t.part, "nation": t.nation},
        {"customer": "c_name", "supplier": "s_name", "part": "p_brand", "nation": "n_name"})
    return inventory.delete_plan(inv, DELETE_PREFIXES)


@query
def config_validation(spark: SparkSession, base: str) -> DataFrame:
    """every rule on every line; all failures listed, first one named."""
    li = Tables(spark, base).lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rules = [("quantity_min", quality.at_least("l_quantity", 2)),
             ("keys_distinct", quality.all_distinct("l_orderkey", "l_partkey", "l_suppkey")),
             ("price_positive", quality.positive("l_extendedprice"))]
    return quality.validate(li, rules).select(
        "l_orderkey", "l_linenumber", "failures", "first_failure", "n_failures", "valid")


_ORDER_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


@query
def admit_new(spark: SparkSession, base: str) -> DataFrame:
    """orders with no line yet (anti join)."""
    t = Tables(spark, base)
    existing = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return inventory.admit_new(t.orders.select(*_ORDER_COLS), existing, "o_orderkey")


@query
def reject_existing(spark: SparkSession, base: str) -> DataFrame:
    """orders that already have a returned line (semi join)."""
    t = Tables(spark, base)
    existing = (t.lineitem.where(F.col("l_returnflag") == "R")
                .select(F.col("l_orderkey").alias("o_orderkey")))
    return inventory.reject_existing(t.orders.select(*_ORDER_COLS), existing, "o_orderkey")


def _requests(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Events as requests by user, and the BUILDING customers as what exists:
    most requests are new."""
    requests = t.events.select("event_id", F.col("user_id").alias("key"))
    return requests, t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("key"))


@query
def admit_sketched(spark: SparkSession, base: str) -> DataFrame:
    """events whose user does not exist yet; what a sketch of the existing
    keys lacks is not shuffled."""
    return inventory.admit_new(*_requests(Tables(spark, base)), "key", sketch=True)


@query
def reject_sketched(spark: SparkSession, base: str) -> DataFrame:
    """events whose user exists; what the sketch lacks is dropped before
    the join."""
    return inventory.reject_existing(*_requests(Tables(spark, base)), "key", sketch=True)


# --- lookups -----------------------------------------------------------------------

def _building_customers(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query
def name_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Each event's user resolved against the known (BUILDING)
    customers; unknown ones stay with ``resolved = false``."""
    t = Tables(spark, base)
    req = t.events.select("event_id", "user_id")
    return (inventory.lookup_names(req, _building_customers(t), "user_id", "c_custkey")
            .select("event_id", "user_id", "c_name", "resolved"))


@query
def unknown_names(spark: SparkSession, base: str) -> DataFrame:
    """J1 reject list: requested users that are not known, with counts."""
    t = Tables(spark, base)
    return inventory.unknown_names(t.events.select("user_id"), _building_customers(t),
                                   "user_id", "c_custkey")


@query
def prefix_collisions(spark: SparkSession, base: str) -> DataFrame:
    """customers' names without leading zeros that are strict prefixes of
    others (``Customer#1`` and ``Customer#12``)."""
    c = Tables(spark, base).customer.select(F.regexp_replace("c_name", "#0+", "#").alias("name"))
    return inventory.prefix_collisions(c, "name")


# --- aggregations --------------------------------------------------------------------

@query
def component_status(spark: SparkSession, base: str) -> DataFrame:
    """Per conversation, which roles are present; the first missing one
    in order system, user, assistant names the status."""
    conv = Tables(spark, base).conversations.select("conv_id", "role")
    return inventory.component_status(conv, "conv_id", "role", ("system", "user", "assistant"))


@query
def worker_count(spark: SparkSession, base: str) -> DataFrame:
    """A1: suppliers per nation, zero kept."""
    t = Tables(spark, base)
    return inventory.count_members(t.nation.select("n_nationkey", "n_name"),
                                   t.supplier.select("s_nationkey"),
                                   "n_nationkey", "s_nationkey", out="n_suppliers")


def _stages(t: Tables) -> DataFrame:
    """Conversations as command stages: turn = stage, role = token; system
    turns are still running (null code), long assistant turns failed."""
    code = (F.when(F.col("role") == "system", F.lit(None).cast("int"))
            .when((F.col("role") == "assistant") & (F.length("text") > 1000), F.lit(1))
            .otherwise(F.lit(0)))
    return t.conversations.select("conv_id", "turn", "role", "text", code.alias("code"))


@query
def stage_outcome(spark: SparkSession, base: str) -> DataFrame:
    """A2 A3: failed / running flags per command."""
    return sequences.stage_outcome(_stages(Tables(spark, base)), ["conv_id"], "turn", "code")


TURN_BLOCK = 1024  # places rows; results do not depend on it


@query
def stage_render(spark: SparkSession, base: str) -> DataFrame:
    """The stages of each command in order, with token, exit code,
    output (the whole turn text) and error (that of a failed stage)."""
    st = _stages(Tables(spark, base))
    return sequences.render_stages(st, ["conv_id"], "turn", "role", "code", "text",
                                   F.when(F.col("code") != 0, F.col("text")), bucket=F.floor(F.col("turn") / TURN_BLOCK))


@query
def stage_text(spark: SparkSession, base: str) -> DataFrame:
    """Each conversation's roles in turn order as one text."""
    conv = Tables(spark, base).conversations.select("conv_id", "turn", "role")
    return sequences.rendered(conv, ["conv_id"], " | ", "turn", "role")


@query
def copy_plan(spark: SparkSession, base: str) -> DataFrame:
    """Orders as copy requests; lines not flagged N come from their
    supplier's host, the target is the customer's host unless the order is
    open (local)."""
    t = Tables(spark, base)
    sources = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_returnflag") != "N",
               F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string"))).alias("host"))
    targets = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "O",
               F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))).alias("host"))
    return keyed.copy_verdict(sources, targets, "o_orderkey")


@query
def last_wins(spark: SparkSession, base: str) -> DataFrame:
    """One line per (order, line number), the last by ship date,
    part and supplier."""
    li = Tables(spark, base).lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return keyed.last_wins(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query
def capacity_rollup(spark: SparkSession, base: str) -> DataFrame:
    """Lines as nodes of part types, rolled up per order and then per
    customer (cores = part size, quantity as an integer)."""
    t = Tables(spark, base)
    nodes = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    types = t.part.select("p_partkey", "p_size")
    per_order = keyed.capacity_rollup(
        nodes, types, "l_partkey", "p_partkey", ["l_orderkey"],
        {"total_cores": F.col("p_size").cast("bigint"),
         "total_quantity": F.col("l_quantity").cast("bigint")})
    orders = t.orders.select("o_orderkey", "o_custkey")
    return (per_order.join(orders, per_order["l_orderkey"] == orders["o_orderkey"])
            .groupBy("o_custkey")
            .agg(F.sum("n_nodes").alias("n_nodes"), F.sum("total_cores").alias("total_cores"),
                 F.sum("total_quantity").alias("total_quantity")))


# --- sorts ----------------------------------------------------------------------------

RANK_BLOCK = 1 << 20


@query
def catalog_rank(spark: SparkSession, base: str) -> DataFrame:
    """O1: position of each part within its type in catalog order (size,
    then key); the size buckets the numbering."""
    part = Tables(spark, base).part.select("p_partkey", "p_type", "p_size")
    # (size, key block) is non-decreasing in the order (size, key), so a
    # hot type, or a hot (type, size), is numbered by many tasks.
    bucket = F.struct(F.col("p_size"), F.floor(F.col("p_partkey") / RANK_BLOCK))
    return keyed.catalog_rank(part, "p_type", "p_size", "p_partkey", out="rank", bucket=bucket)


# --- sequences ------------------------------------------------------------------------

def _ranges(spark: SparkSession) -> int:
    """Ranges that ordered rows are cut into: a few for each shuffle partition."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _user_ranges(ev: DataFrame) -> DataFrame:
    return ordered.range_bucket(ev, ["user_id"], ["ts", "event_id"], _ranges(ev.sparkSession), out="bucket")


@query
def delimiter_runs(spark: SparkSession, base: str) -> DataFrame:
    """G1: each user's events split at ``error`` events into runs."""
    ev = _user_ranges(Tables(spark, base).events.select("user_id", "ts", "event_id", "event_type"))
    return sequences.split_runs(ev, ["user_id"], ["ts", "event_id"], "event_type", "error",
                                id_col="event_id", ts_col="ts", bucket=F.col("bucket")).drop("bucket")


@query
def concat_ordered(spark: SparkSession, base: str) -> DataFrame:
    """Per conversation, what was said to the assistant (system and user
    turns), then what it answered, renumbered."""
    conv = Tables(spark, base).conversations.select("conv_id", "turn", "role")
    left = conv.where(~F.col("role").eqNullSafe("assistant"))
    right = conv.where(F.col("role") == "assistant")
    return sequences.concat_ordered(left, right, ["conv_id"], ["turn"],
                                    bucket=F.floor(F.col("turn") / TURN_BLOCK))


@query
def node_expand(spark: SparkSession, base: str) -> DataFrame:
    """Suppliers as cluster configurations with ``s_nationkey``
    workers; one row per node."""
    cfg = Tables(spark, base).supplier.select("s_name", "s_nationkey")
    return sequences.expand_nodes(cfg, "s_name", "s_nationkey")


@query
def rule_expand(spark: SparkSession, base: str) -> DataFrame:
    """Suppliers as cluster configurations; their firewall rules."""
    cfg = Tables(spark, base).supplier.select(
        "s_name", *[(F.lit(p) + F.col("s_nationkey") * 10).alias(n)
                    for n, p in (("ipc", 9753), ("dash", 9756), ("nanny", 9759))])
    return sequences.expand_rules(cfg, "s_name", "ipc", "dash", "nanny").drop("destination_ips")


# --- state and time -----------------------------------------------------------------

RUN_TIMEOUT_S = 24 * 3600.0
POLL_S = 1.0
VALIDITY_ASOF = "1998-01-01 00:00:00"


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "user_id", "event_type")


@query
def first_success(spark: SparkSession, base: str) -> DataFrame:
    """Per user, the first purchase and the attempts before it."""
    return lifecycle.first_success(_events(Tables(spark, base)), "user_id", "ts", "event_id",
                                   F.col("event_type") == "purchase")


@query
def run_timeout(spark: SparkSession, base: str) -> DataFrame:
    """Signup -> next purchase within 24 h, polled every second."""
    return lifecycle.run_timeout(_events(Tables(spark, base)), "user_id", "ts", "event_id",
                                 F.col("event_type") == "signup", F.col("event_type") == "purchase",
                                 RUN_TIMEOUT_S, POLL_S)


@query
def latest_state(spark: SparkSession, base: str) -> DataFrame:
    """Newest event per user."""
    ev = Tables(spark, base).events.select("user_id", "event_id", "ts", "event_type", "value")
    return lifecycle.latest_state(ev, "user_id", ["ts", "event_id"])


@query
def phase_durations(spark: SparkSession, base: str) -> DataFrame:
    """T4: time from each event to the user's next one."""
    out = lifecycle.phase_durations(_user_ranges(_events(Tables(spark, base))), "user_id", "ts", "event_id",
                                    bucket=F.col("bucket"))
    return out.select("user_id", "event_id", "event_type", "ts", "next_ts", "duration_us")


@query
def barrier_violations(spark: SparkSession, base: str) -> DataFrame:
    """T5: orders whose first line shipped no later than the order."""
    t = Tables(spark, base)
    return quality.barrier_violations(t.orders.select("o_orderkey", "o_orderdate"),
                                      t.lineitem.select("l_orderkey", "l_shipdate"),
                                      "o_orderkey", "l_orderkey", "o_orderdate", "l_shipdate")


@query
def validity_status(spark: SparkSession, base: str) -> DataFrame:
    """Each order as a certificate issued at its date, valid 730 days."""
    orders = Tables(spark, base).orders.select("o_orderkey", "o_orderdate")
    return quality.validity_status(orders, "o_orderdate", VALIDITY_ASOF, 730).select(
        "o_orderkey", "not_before", "not_after", "status")


# --- scalar functions -------------------------------------------------------------------

@query
def suffix_split(spark: SparkSession, base: str) -> DataFrame:
    """The part of each customer name after ``#``."""
    cust = Tables(spark, base).customer.select("c_custkey", "c_name")
    return cust.withColumn("suffix", text.name_suffix("c_name", "#"))


@query
def label_cast(spark: SparkSession, base: str) -> DataFrame:
    """The ``k`` label of each event's properties as an integer."""
    ev = Tables(spark, base).events.select("event_id", "props")
    labels = F.from_json("props", "map<string,string>")
    return ev.select("event_id", text.label_int(labels, "k").alias("k"))


@query
def path_parse(spark: SparkSession, base: str) -> DataFrame:
    """Page URLs written with backslashes, normalised, then split
    into host and path; every third without its scheme (a local path), every
    fifth with a port (more than one colon)."""
    pages = Tables(spark, base).pages.select("page_id", "url")
    k, u = F.col("page_id"), F.col("url")
    named = (F.when(k % 3 == 0, F.replace(u, F.lit(":"), F.lit("")))
             .when(k % 5 == 0, F.concat(u, F.lit(":8080"))).otherwise(u))
    p = text.normalize_path(F.replace(named, F.lit("/"), F.lit("\\")))
    out = pages.select("page_id", p.alias("path"))
    return out.select("page_id", "path", text.path_kind("path").alias("kind"),
                      text.path_host("path").alias("host"), text.path_rest("path").alias("rest"))


@query
def decode_safe(spark: SparkSession, base: str) -> DataFrame:
    """Each document's bytes as text, whole; a byte that is no UTF-8 is
    put behind German texts, and Spanish ones are null."""
    docs = Tables(spark, base).documents.select("doc_id", "lang", F.encode("text", "UTF-8").alias("b"))
    data = (F.when(F.col("lang") == "de", F.concat(F.col("b"), F.unhex(F.lit("FF"))))
            .when(F.col("lang") != "es", F.col("b")))
    return docs.select("doc_id", F.octet_length(data).cast("bigint").alias("n_bytes"), text.decode_safe(data).alias("text"))


# --- logs --------------------------------------------------------------------------------

# Fixed mapping of event types to log levels for the log queries.
EVENT_LEVELS = {"error": "ERROR", "purchase": "WARNING", "signup": "INFO", "view": "DEBUG", "click": "DEBUG"}
LOG_THRESHOLD = 30


def _event_lines(events: DataFrame) -> DataFrame:
    ev = events.select("event_id", "ts", "user_id", "event_type")
    level = F.try_element_at(F.create_map(*[F.lit(x) for kv in EVENT_LEVELS.items() for x in kv]),
                             F.col("event_type"))
    return logs.render_lines(ev, F.concat(F.lit("user"), F.col("user_id").cast("string")), level, "ts",
                             F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "),
                                      F.col("event_type")))


@query
def log_roundtrip(spark: SparkSession, base: str) -> DataFrame:
    """Events written as text files of log lines in the shared folder,
    read and parsed back."""
    path = streaming.stream_workdir(spark, "log")[0]
    logs.write_lines(_event_lines(Tables(spark, base).events), path)
    return logs.parse_lines(logs.read_lines(spark, path))


@query
def log_level_filter(spark: SparkSession, base: str) -> DataFrame:
    """parsed log records at WARNING or above; the level is tested on
    the line before the rest of it is parsed."""
    lines = logs.lines_at(_event_lines(Tables(spark, base).events), LOG_THRESHOLD)
    return logs.level_filter(logs.parse_lines(lines), LOG_THRESHOLD)


# --- streams (run to completion with availableNow; oracle = the batch SQL) ----------

FILES_PER_TRIGGER = 256  # bounds a micro-batch
WATERMARK = streaming.REPLAY


def _event_stream(spark: SparkSession, base: str, max_files: int = FILES_PER_TRIGGER) -> DataFrame:
    """The events table as a stream, be it one file or a folder of them (a
    pattern, because the file source takes a bare path for a folder)."""
    t = Tables(spark, base)
    return (spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", max_files)
            .parquet(f"{base}/events.parque[t]"))


def _bucket_log(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a bucket stream to its end; the folded log."""
    out, ckpt = streaming.stream_workdir(spark, name)
    streaming.run_upserts(stream, out, ckpt).awaitTermination()
    return streaming.read_upserts(spark, out, ["user_id", "_ff_b"])


def _streamed_first_success(spark: SparkSession, base: str, name: str) -> tuple[DataFrame, DataFrame]:
    aggregates = lifecycle.success_aggregates("ts", "event_id", F.col("event_type") == "purchase")
    stream = streaming.bucket_stream(_event_stream(spark, base), "user_id", "ts", aggregates, WATERMARK)
    buckets = _bucket_log(spark, stream, name)
    return buckets, lifecycle.first_success_from(buckets, _events(Tables(spark, base)), "user_id", "ts", "event_id",
                                                 "_ff_b", lifecycle.day_bucket("ts"))


@query
def first_success_stream(spark: SparkSession, base: str) -> DataFrame:
    """T1 as a Structured Streaming job; folded result."""
    return _streamed_first_success(spark, base, "first_success")[1]


@query
def latest_state_stream(spark: SparkSession, base: str) -> DataFrame:
    """T3 as a streaming aggregate in update mode; folded result."""
    ev = _event_stream(spark, base)
    out, ckpt = streaming.stream_workdir(spark, "latest_state")
    q = streaming.run_upserts(
        streaming.latest_state_stream(ev, "user_id", ["ts", "event_id"], ["event_id", "ts", "event_type", "value"]),
        out, ckpt)
    q.awaitTermination()
    return streaming.read_upserts(spark, out, ["user_id"])


@query
def run_timeout_stream(spark: SparkSession, base: str) -> DataFrame:
    """T2 as a Structured Streaming job; ``asof`` is the latest event time
    the stream has seen, in milliseconds."""
    start, end = F.col("event_type") == "signup", F.col("event_type") == "purchase"
    stream = streaming.bucket_stream(_event_stream(spark, base), "user_id", "ts",
                                     lifecycle.run_aggregates("ts", "event_id", start, end), WATERMARK)
    buckets = _bucket_log(spark, stream, "run_timeout")
    return lifecycle.run_timeout_from(buckets, _events(Tables(spark, base)), "user_id", "ts", "event_id", end, "_ff_b",
                                      lifecycle.day_bucket("ts"), RUN_TIMEOUT_S, POLL_S,
                                      streaming.last_millisecond(buckets))


@query
def run_timer_stream(spark: SparkSession, base: str) -> DataFrame:
    """T2 with an event-time timer: runs from signup to purchase whose 24 h
    have passed by the latest event, each written when the watermark did."""
    t = Tables(spark, base)
    start, end = F.col("event_type") == "signup", F.col("event_type") == "purchase"
    return streaming.replay_closed(
        lambda ev: streaming.timer_stream(ev, "user_id", "ts", start, end, RUN_TIMEOUT_S, POLL_S, WATERMARK),
        _event_stream(spark, base), t.events, "ts", "run_timer")


@query
def latest_closed_stream(spark: SparkSession, base: str) -> DataFrame:
    """T3 with bounded state: the newest event per user of the days that
    closed by the latest event."""
    cols = ["event_id", "ts", "event_type", "value"]
    days = streaming.replay_closed(
        lambda ev: streaming.closed_state_stream(ev, "user_id", "ts", ["ts", "event_id"], cols, WATERMARK),
        _event_stream(spark, base), Tables(spark, base).events, "ts", "latest_closed")
    return keyed.last_wins(days, ["user_id"], ["ts", "event_id"], cols)


@query
def log_level_stream(spark: SparkSession, base: str) -> DataFrame:
    """The event stream written as text files in one folder a level,
    then read at WARNING or above and parsed."""
    out, checkpoint = streaming.stream_workdir(spark, "log_level")
    lines = _event_lines(_event_stream(spark, base))
    logs.stream_by_level(lines, out, checkpoint).awaitTermination()
    return logs.parse_lines(logs.read_by_level(spark, out, LOG_THRESHOLD))


LOOKUP_NAME = "Customer#000000042"


@query
def point_lookup_stream(spark: SparkSession, base: str) -> DataFrame:
    """The customers as a stream into a snapshot with Bloom filters of the
    names, then one looked up by its exact name."""
    schema = Tables(spark, base).customer.schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(f"{base}/customer.parque[t]")
    out, checkpoint = streaming.stream_workdir(spark, "point_lookup")
    rows = rows.select("c_name", "c_custkey", "c_nationkey")
    (rows.writeStream.format("parquet").options(**lookup_options("c_name"))
     .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return inventory.lookup_one(spark.read.schema(rows.schema).parquet(out), LOOKUP_NAME, "c_name")


@query
def cluster_status(spark: SparkSession, base: str) -> DataFrame:
    """A7 with the reference's name tests: nations as cluster prefixes, one
    worker per supplier named after its nation, a scheduler where the
    nation has a supplier with balance over 5000, firewalls outside region
    1, networks outside region 2.  ``NATION_1`` also sees the workers of
    ``NATION_10`` .. ``NATION_19`` (bare ``startswith``)."""
    t = Tables(spark, base)
    sn = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal").join(
        t.nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    workers = sn.select(F.concat(F.col("n_name"), F.lit("-node-worker"), F.col("s_suppkey").cast("string")).alias("name"))
    schedulers = (sn.where(F.col("s_acctbal") > 5000)
                  .select(F.concat(F.col("n_name"), F.lit("-node-scheduler")).alias("name")).distinct())
    nation = t.nation.select("n_name", "n_regionkey")
    firewalls = nation.where(F.col("n_regionkey") != 1).select(F.concat(F.col("n_name"), F.lit("-firewall")).alias("name"))
    networks = nation.where(F.col("n_regionkey") != 2).select(F.concat(F.col("n_name"), F.lit("-network")).alias("name"))
    clusters = nation.select(F.col("n_name").alias("prefix"))
    return inventory.cluster_status(clusters, workers.unionByName(schedulers), firewalls, networks)


@query
def first_success_final(spark: SparkSession, base: str) -> DataFrame:
    """T1, settled users only: those whose first purchase lies before the
    latest event time the stream has seen (in milliseconds)."""
    buckets, result = _streamed_first_success(spark, base, "first_success_final")
    return streaming.settled(result, streaming.last_millisecond(buckets))


# --- the reference's own rule sets, strict casts ------------------------------------

@query
def cluster_validation(spark: SparkSession, base: str) -> DataFrame:
    """F5 with the reference's cluster and node rules: suppliers as cluster
    configurations, some of them wrong (no workers, privileged or equal
    ports, no wait)."""
    s = Tables(spark, base).supplier.select("s_suppkey", "s_nationkey")
    k = F.col("s_suppkey")
    cfg = s.select("s_suppkey", F.col("s_nationkey").cast("int").alias("workers"),
                   F.when(k % 7 == 0, 80).otherwise(9753).alias("dask_ipc"),
                   F.when(k % 5 == 0, 9753).otherwise(9756).alias("dask_dash"), F.lit(9759).alias("dask_nanny"),
                   F.when(k % 11 == 0, 0.0).otherwise(0.5).alias("wait"))
    return quality.validate(cfg, [*quality.cluster_rules(), *quality.node_rules()]).select(
        "s_suppkey", "failures", "first_failure", "n_failures", "valid")


@query
def access_validation(spark: SparkSession, base: str) -> DataFrame:
    """F5 with the reference's ssh and certificate rules: customers as hosts,
    some without a key path, cipher or validity."""
    c = Tables(spark, base).customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    k = F.col("c_custkey")
    cfg = c.select("c_custkey", F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("user"),
                   F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("/keys/"), k.cast("string"))).alias("fn_private"),
                   F.col("c_nationkey").cast("int").alias("port"),
                   F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise("aes128").alias("cipher"),
                   (k % 13).alias("valid_days"))
    rules = [*quality.ssh_rules(), *[r for r in quality.certificate_rules() if r[0] == "valid_days_positive"]]
    return quality.validate(cfg, rules).select("c_custkey", "failures", "first_failure", "n_failures", "valid")


@query
def label_strict(spark: SparkSession, base: str) -> DataFrame:
    """E3 strict: the number in each customer's name; bad text would raise."""
    c = Tables(spark, base).customer.select("c_custkey", "c_name")
    labels = F.create_map(F.lit("n"), text.name_suffix("c_name", "#"))
    return c.select("c_custkey", text.label_int(labels, "n", strict=True).alias("n"))


# --- names and provisioning ------------------------------------------------------------

HOST_PREFIX = "CL1"


def _servers(t: Tables) -> DataFrame:
    """Server names: suppliers as workers of their nation's cluster, and a
    scheduler for each nation."""
    s = t.supplier.select("s_suppkey", "s_nationkey")
    workers = s.select(F.concat(F.lit("CL"), F.col("s_nationkey").cast("string"), F.lit("-node-worker"),
                                F.floor(F.col("s_suppkey") / 25).cast("string")).alias("name")).distinct()
    schedulers = t.nation.select(F.concat(F.lit("CL"), F.col("n_nationkey").cast("string"), F.lit("-node-scheduler")).alias("name"))
    return workers.unionByName(schedulers)


@query
def host_index(spark: SparkSession, base: str) -> DataFrame:
    """The host names cluster ``CL1`` answers to; ``CL10`` and
    others match its prefix too, and the greatest server name wins."""
    return inventory.host_index(_servers(Tables(spark, base)), HOST_PREFIX)


@query
def resource_kind(spark: SparkSession, base: str) -> DataFrame:
    """Server, firewall and customer names split into prefix and
    component; null where a name is no cluster's."""
    t = Tables(spark, base)
    nets = t.nation.select(F.explode(F.array(*[F.concat(F.lit("CL"), F.col("n_nationkey").cast("string"), F.lit(x))
                                               for x in ("-firewall", "-network")])).alias("name"))
    names = _servers(t).unionByName(nets).unionByName(t.customer.select(F.col("c_name").alias("name")))
    kind = inventory.classify_resource("name")
    return names.select("name", kind["prefix"].alias("prefix"), kind["component"].alias("component"))


@query
def provisioning_phases(spark: SparkSession, base: str) -> DataFrame:
    """T4 from log lines: each node's tagged messages as phases that last
    until its next message."""
    t = Tables(spark, base)
    ev = t.events.select("event_id", "ts", "user_id", "event_type")
    u = F.col("user_id")
    lines = logs.render_lines(ev, F.concat(F.lit("cluster"), (u % 5).cast("string")), F.lit("INFO"), "ts",
                              F.concat(F.when(u % 4 != 0, F.concat(F.lit("[worker"), (u % 3).cast("string"), F.lit("] ")))
                                       .otherwise(""), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"), F.lit(" ...")))
    return lifecycle.provisioning_phases(logs.parse_lines(lines), ranges=_ranges(spark))
