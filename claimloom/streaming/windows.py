"""Event-time windows, the request limiter and job states, as batch queries and as streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.model import table
from claimloom.plans.lineage import checkpoint_dir, cut, delete_folder
from claimloom.registry import query
from claimloom.sources.files import latest_attempts

TERMINAL = ("SUCCEEDED", "FAILED", "CANCELLED", "EXPIRED")


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str | None = None, time: str = "ts", key: str = "event_type") -> DataFrame:
    """Tumbling or sliding counts; ``late`` sets the watermark of a stream."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    counts = rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None, time: str = "ts", key: str = "user_id") -> DataFrame:
    """Runs of a key's events no further apart than ``gap``."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def limiter_view(requests: DataFrame, limit: int, seconds: int, time: str = "ts", key: str = "user_id", order: str = "event_id") -> DataFrame:
    """How many of a key's requests fall in the window that ends with each (rejected ones count too), and what is left."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-seconds * 1_000_000 + 1, 0)
    seen = requests.withColumn("_t", at).withColumn("seen", F.count("*").over(w))
    return seen.select(key, order, "seen", F.greatest(F.lit(0), F.lit(limit) - F.col("seen")).alias("remaining"))


def limit_requests(requests: DataFrame, limit: int = 120, seconds: int = 60, time: str = "ts", key: str = "user_id", order: str = "event_id") -> DataFrame:
    """A stream's requests with ``allowed``, ``remaining`` and ``reset`` by each key's last accepted times.

    State is at most ``limit`` times a key, and goes when the watermark has passed the key's last request by a window.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = f"{key} long, {order} long, allowed boolean, remaining int, reset double"

    def serve(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values([time, order])
        found = []
        for at, number in zip(rows[time].astype("datetime64[us]").astype("int64") / 1e6, rows[order], strict=True):
            taken = [t for t in taken if t > at - seconds]
            ok = len(taken) < limit
            taken += [at] * ok
            found.append((name[0], number, ok, limit - len(taken), max(0.0, taken[0] + seconds - at)))
        state.update((taken,))
        state.setTimeoutTimestamp(max(int((max(taken) + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=[key, order, "allowed", "remaining", "reset"])

    return requests.withWatermark(time, f"{seconds} seconds").groupBy(key).applyInPandasWithState(serve, out, "taken array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def job_states(events: DataFrame, job: str, state: str, time: str) -> DataFrame:
    """Each job's latest state; a terminal one is never left, whatever arrives later."""
    final = F.col(state).isin(*TERMINAL)
    order = F.struct(F.when(final, F.lit(1)).otherwise(F.lit(0)), F.when(final, -F.unix_micros(F.col(time).cast("timestamp"))).otherwise(F.unix_micros(F.col(time).cast("timestamp"))))
    return events.groupBy(job).agg(F.max_by(state, order).alias("state"), F.count("*").alias("events"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """All that is there now into an in-memory table, then stop; for tests and small results."""
    return stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def idempotent_sink(path: str):
    """A ``foreachBatch`` writer: each batch owns a folder by its id, so a replayed batch replaces itself."""

    def write(frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


class PendingCommit:
    """Batches that are written whole or not at all, in a folder on any shared store.

    ``commit`` notes the batch as pending, replaces its folder and clears the note. A note
    that is still there tells of a commit that broke off: ``recover`` removes that batch, so
    that its replay begins anew; committed batches stay as they are.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def recover(self) -> int | None:
        """The batch whose commit broke off, whose rows are gone now; None after a clean end."""
        fs, home = self._place("")
        if not fs.exists(home):
            return None
        for status in fs.listStatus(home):
            name = status.getPath().getName()
            if name.startswith("_pending-"):
                batch = int(name.removeprefix("_pending-"))
                fs.delete(self._place(f"batch={batch}")[1], True)
                fs.delete(status.getPath(), False)
                return batch
        return None

    def begin(self, batch_id: int) -> None:
        fs, note = self._place(f"_pending-{batch_id}")
        fs.create(note, True).close()

    def commit(self, frame: DataFrame, batch_id: int) -> None:
        self.recover()
        self.begin(batch_id)
        frame.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        fs, note = self._place(f"_pending-{batch_id}")
        fs.delete(note, False)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A folder of event files, or one file, as a stream with the batch table's columns; zoneless times are read as UTC-session times, which watermarks need."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString()) if single else reader.parquet(path)
    return stream.select(*[F.col(n).cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(n) for n, t in stream.dtypes])


def response_class(responses: DataFrame, text: str = "body", finish: str = "finish", used: str = "tokens", cap: int = 8192) -> DataFrame:
    """accepted, truncated, schema_invalid, validation_invalid or transport_error, and whether the cap was near."""
    body = F.from_json(text, "id string, triples array<struct<s string, p string, o string>>")
    whole = F.try_parse_json(text).isNotNull() & body["triples"].isNotNull()
    valid = whole & F.forall(body["triples"], lambda t: (F.length(t["s"]) > 0) & (F.length(t["p"]) > 0) & (F.length(t["o"]) > 0))
    kind = F.when(F.col(text).isNull(), "transport_error").when(F.col(finish) == "MAX_TOKENS", "truncated").when(~F.coalesce(whole, F.lit(False)), "schema_invalid").when(~F.coalesce(valid, F.lit(False)), "validation_invalid").otherwise("accepted")
    return responses.withColumns({"kind": kind, "near_cap": F.col(used) >= cap - 64})


LEVELS = ("high", "medium", "minimal")


def retries(planned: DataFrame, attempts: DataFrame, key: str = "key") -> DataFrame:
    """What is not accepted yet with its next ``level``: one step down, the same again after a transport error; exhausted keys go."""
    done = attempts.where("kind = 'accepted'").select(key).distinct()
    last = latest_attempts(attempts, key, "attempt").select(key, F.col("level").alias("_l"), F.col("kind").alias("_k"))
    left = planned.join(done, key, "left_anti").join(last, key, "left")
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("_l"))
    after = F.when(F.col("_l").isNull(), F.lit(1)).when(F.col("_k") == "transport_error", place).otherwise(place + 1)
    return left.withColumn("level", F.get(F.array(*map(F.lit, LEVELS)), (after - 1).cast("int"))).where("level is not null").drop("_l", "_k")


@query("m8_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    return windowed_counts(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("m8_sliding", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) x GROUP BY ALL")
def sliding(spark, d):
    return windowed_counts(table(spark, d, "events"), "1 hour", "30 minutes").drop("total")


@query("m8_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events) x) y GROUP BY user_id, k")
def session_query(spark, d):
    return sessions(table(spark, d, "events"), "2 hours")


@query("v05_limiter_view", "SELECT user_id, event_id, count(*) OVER w AS seen, greatest(0, 3 - count(*) OVER w) AS remaining FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW)")
def limiter(spark, d):
    return limiter_view(table(spark, d, "events"), 3, 36000)


_ACCEPTED = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  r(user_id, event_id, k, allowed, taken) AS (SELECT user_id, event_id, k, true, [t] FROM e WHERE k = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.k, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, e.t) ELSE kept END
    FROM (SELECT r.user_id, r.k, e.t AS now, list_filter(r.taken, lambda x: x > e.t - 36000000000) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)
  SELECT user_id, event_id, allowed, CAST(3 - len(taken) AS INT) AS remaining FROM r"""


@query("v05_accepted", _ACCEPTED)
def accepted(spark, d):
    """The events, read as a stream, through the limiter that counts accepted requests alone: 3 a user in 10 hours."""
    home = f"{checkpoint_dir(spark)}/limiter-{uuid.uuid4().hex}"
    limited = limit_requests(read_events(spark, f"{d}/events.parquet"), 3, 36000)
    limited.writeStream.foreachBatch(idempotent_sink(f"{home}/out")).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start().awaitTermination()
    out = cut(spark.read.parquet(f"{home}/out").select("user_id", "event_id", "allowed", "remaining"))
    delete_folder(spark, home)
    return out


_STATES = "CASE event_id % 11 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'CANCELLED' WHEN 3 THEN 'EXPIRED' ELSE 'RUNNING' END"


@query("v01_job_states", f"SELECT job, state, events FROM (SELECT job, state, count(*) OVER (PARTITION BY job) AS events, row_number() OVER (PARTITION BY job ORDER BY state = 'RUNNING', CASE WHEN state = 'RUNNING' THEN -epoch_us(ts) ELSE epoch_us(ts) END) AS k FROM (SELECT user_id * 100 + event_id % 7 AS job, {_STATES} AS state, ts + to_microseconds(event_id) AS ts FROM events) y) x WHERE k = 1")
def states(spark, d):
    rows = table(spark, d, "events").selectExpr("user_id * 100 + event_id % 7 as job", f"{_STATES} as state", "timestamp_micros(unix_micros(cast(ts as timestamp)) + event_id) as at")
    return job_states(rows, "job", "state", "at")


@query("v02_response_classes", "SELECT CASE WHEN event_id % 10 = 0 THEN 'transport_error' WHEN event_id % 9 = 0 THEN 'truncated' WHEN event_id % 8 = 0 THEN 'schema_invalid' WHEN event_id % 7 = 0 THEN 'validation_invalid' ELSE 'accepted' END AS kind, count(*) AS n, count(*) FILTER (event_id % 100 >= 36) AS near FROM events GROUP BY 1")
def classes(spark, d):
    i = F.col("event_id")
    body = F.when(i % 10 == 0, F.lit(None)).when(i % 8 == 0, '{"id": "x", "trip').when(i % 7 == 0, '{"id": "x", "triples": [{"s": "", "p": "b", "o": "c"}]}').otherwise('{"id": "x", "triples": [{"s": "a", "p": "b", "o": "c"}]}')
    rows = table(spark, d, "events").select(body.alias("body"), F.when(i % 9 == 0, "MAX_TOKENS").otherwise("STOP").alias("finish"), (i % 100 + 8092).alias("tokens"))
    return response_class(rows).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("near_cap").alias("near"))


@query("v03_retry_ladder", "SELECT event_id AS key, CASE WHEN event_id % 5 = 1 THEN 'medium' WHEN event_id % 5 = 2 THEN 'high' WHEN event_id % 5 = 3 THEN 'high' END AS level FROM events WHERE event_id % 5 IN (1, 2, 3)")
def ladder(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"))
    m = F.col("key") % 5
    tried = e.where(m != 3).select("key", F.lit(1).alias("attempt"), F.lit("high").alias("level"), F.when(m == 0, "accepted").when(m == 1, "schema_invalid").when(m == 2, "transport_error").otherwise("accepted").alias("kind"))
    return retries(e, tried)


@query("v09_code_assignment", "SELECT event_type AS tag, min(event_id) AS first_seen, CAST(dense_rank() OVER (ORDER BY min(event_id)) AS INT) AS code, count(DISTINCT user_id % 20) AS pages FROM events GROUP BY event_type")
def codes(spark, d):
    tags = table(spark, d, "events").groupBy(F.col("event_type").alias("tag")).agg(F.min("event_id").alias("first_seen"), F.count_distinct(F.col("user_id") % 20).alias("pages"))
    return tags.withColumn("code", F.dense_rank().over(Window.orderBy("first_seen")))  # one row a tag


#: Provisional ids that one page may need (fixed value).
MOST_PROVISIONAL = 99


def reassembled(proposals: DataFrame, annotations: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A page's chunks put together: its categories, its annotations with their new ids, and its errors.

    ``chunks(page, chunk, kind)`` says how each chunk was answered; ``proposals(page, chunk,
    prefix, place, id, label)`` holds what it proposed under ids of its own and
    ``annotations(page, chunk, place, s, r, o)`` what it says with them. Labels that agree but
    for case and blanks are one category of the page; ids are the prefix and a number in the
    order of first mention. Ids without a proposal stay as they are (they are known codes)
    unless they begin with a prefix. A page with a chunk that was not accepted, with over
    ``MOST_PROVISIONAL`` categories of a prefix or with an id that its chunk did not propose
    has errors, and nothing else. All is grouping by page and joins on (page, chunk, id).
    """
    key = F.trim(F.regexp_replace(F.lower("label"), r"\s+", " "))
    named = proposals.withColumn("label_key", key)
    order = F.struct("chunk", "place")
    first = named.groupBy("page", "prefix", "label_key").agg(F.min(order).alias("at"), F.min_by("label", order).alias("label"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("page", "prefix").orderBy("at")))
    codes = cut(ranked.select("page", "prefix", "label_key", "label", "n", F.concat("prefix", F.lpad(F.col("n").cast("string"), 2, "0")).alias("final")))
    many = codes.groupBy("page", "prefix").agg(F.max("n").alias("n")).where(F.col("n") > MOST_PROVISIONAL).select("page", F.lit("too many provisional categories").alias("error"))
    refused = chunks.where("kind <> 'accepted'").select("page", F.concat_ws(" ", F.lit("chunk"), F.col("chunk").cast("string"), F.col("kind")).alias("error"))
    known = named.groupBy("page", "chunk", "id", "prefix").agg(F.max_by("label_key", "place").alias("label_key")).join(codes.select("page", "prefix", "label_key", "final"), ["page", "prefix", "label_key"]).select("page", "chunk", "id", "final")
    prefixes = [r.prefix for r in proposals.select("prefix").distinct().collect()]  # two: entities and relations
    parts = annotations
    for end in ("s", "r", "o"):
        parts = parts.join(known.withColumnRenamed("id", end), ["page", "chunk", end], "left")
        given = F.lit(False)
        for prefix in prefixes:
            given = given | F.col(end).rlike(f"^{prefix}[0-9]")
        parts = parts.withColumn(f"_{end}", F.coalesce("final", F.when(~given, F.col(end)))).drop("final")
    parts = cut(parts)
    loose = parts.where("_s is null or _r is null or _o is null").select("page", F.lit("an id that was not proposed").alias("error"))
    errors = cut(refused.union(many).union(loose).distinct())
    bad = errors.select("page").distinct()
    categories = codes.join(bad, "page", "left_anti").select("page", F.col("final").alias("id"), "label")
    return categories, parts.join(bad, "page", "left_anti").select("page", "chunk", "place", F.col("_s").alias("s"), F.col("_r").alias("r"), F.col("_o").alias("o")), errors


_CHUNKED = "SELECT user_id AS page, event_id // 200 AS chunk, event_id % 200 AS place, event_type, event_id FROM events"


@query(
    "v11_reassembled",
    f"""WITH c AS ({_CHUNKED}), f AS (SELECT page, event_type AS k, min(chunk * 1000 + place) AS first_at FROM c GROUP BY ALL),
    n AS (SELECT page, k, row_number() OVER (PARTITION BY page ORDER BY first_at) AS n FROM f), bad AS (SELECT DISTINCT page FROM c WHERE event_id % 197 = 0)
    SELECT c.page, c.chunk, c.place, 'NE' || lpad(CAST(n.n AS VARCHAR), 2, '0') AS s, 'R1' AS r, 'E7' AS o FROM c JOIN n ON n.page = c.page AND n.k = c.event_type WHERE c.page NOT IN (SELECT page FROM bad)""",
)
def reassembly(spark, d):
    """Each user's events as a page in chunks of 200 numbers: a chunk proposes its event types anew, in one case or the other."""
    rows = table(spark, d, "events").selectExpr("user_id as page", "event_id div 200 as chunk", "event_id % 200 as place", "event_type", "event_id")
    label = F.when(F.col("chunk") % 2 == 0, F.concat(F.lit(" "), F.upper("event_type"))).otherwise(F.col("event_type"))
    own = rows.groupBy("page", "chunk", "event_type").agg(F.min("place").alias("place")).withColumn("id", F.concat(F.lit("NE"), F.crc32("event_type").cast("string")))
    proposals = own.select("page", "chunk", F.lit("NE").alias("prefix"), "place", "id", label.alias("label"))
    notes = rows.select("page", "chunk", "place", F.concat(F.lit("NE"), F.crc32("event_type").cast("string")).alias("s"), F.lit("R1").alias("r"), F.lit("E7").alias("o"))
    answers = rows.groupBy("page", "chunk").agg(F.when(F.min(F.col("event_id") % 197) == 0, "truncated").otherwise("accepted").alias("kind"))
    return reassembled(proposals, notes, answers)[1]


@query("v11_chunks", "SELECT (event_id - (SELECT min(event_id) FROM events)) // 100 AS chunk, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def chunks(spark, d):
    e = table(spark, d, "events")
    least = F.broadcast(e.agg(F.min("event_id").alias("m")))
    return e.join(least).groupBy(F.floor((F.col("event_id") - F.col("m")) / 100).alias("chunk")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
