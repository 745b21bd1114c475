"""Registered queries over the whole tables; each derives its columns from its operator's outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def removed_length(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


@query
def op10_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import without_repeated_windows

    out = without_repeated_windows(table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", removed_length("removed").alias("n_removed"),
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), capacity=1024).select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import score

    fold = crc_mod("doc_id", 7)
    out = score(table(spark, sf_dir, "documents"), train=fold != 2)
    return out.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import without_repeated_strings

    out = without_repeated_strings(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", removed_length("removed").alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import KINDS, number_of, scan, written

    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [number_of("base", k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *count, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      written(F.col("spans")).alias("spans"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, table(spark, sf_dir, "labels"), train=crc_mod("doc_id", 4) != 2)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(docs, table(spark, sf_dir, "labels"), train=crc_mod("doc_id", 3) != 1)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import with_leaks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("leaks").alias("x")).select(
        "doc_id", "x.item_id", "x.cosine", F.col("x.lcs").alias("lcs_ratio"), F.col("x.answer").alias("answer_ratio"))


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20, scale=64.0)


SQL["op4_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
           CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * r.e[i])) AS BIGINT) AS score
    FROM v q JOIN v r ON r.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), k AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""


@query
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import cycled, mix

    return mix(table(spark, sf_dir, "documents"), weigh=cycled((3, 1, 2)), share=1.5, epochs=2.0).select(
        "doc_id", "size", "source_size", "target", "taken")


SQL["op12_source_mixing"] = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           CAST('0x' || left(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 15) AS BIGINT) AS u
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
           2.0 * CAST(source_size AS DOUBLE) AS cap
    FROM s
), f AS (  -- filled in the order in which sources reach their caps
    SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0) AS weight_left,
           row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k
    FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
    SELECT *, (CAST(1.5 AS DOUBLE) * (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - cap_before) / weight_left AS level FROM f
), t AS (
    SELECT source, source_size, least(cap, weight * (SELECT level FROM l WHERE cap >= weight * level ORDER BY k LIMIT 1)) AS target
    FROM l
), p AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS repeats FROM t
), g AS (
    SELECT source, u, doc_id, size, count(*) AS copies FROM d GROUP BY ALL
), c AS (
    SELECT g.*, source_size, target, repeats, CAST(floor(target) AS BIGINT) - repeats * source_size
               - (sum(size * copies) OVER (PARTITION BY g.source ORDER BY u, doc_id NULLS FIRST, size) - size * copies) AS room
    FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, source_size, target,
       CAST(repeats * d.size + least(greatest(room, 0), d.size * copies) // copies AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.u = c.u AND d.size = c.size
             AND d.doc_id IS NOT DISTINCT FROM c.doc_id
"""


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth text, by the checksum of its id, goes on periodically from one word on."""
    from .mixing import WORD
    from .tables import picked

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = picked(docs, "doc_id", "text").withColumn("h", h).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    planted = planted.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn(
        "p", F.when(n > 0, (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")))
    again = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return planted.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs

    out = periodic_runs(with_planted_period(table(spark, sf_dir, "documents")), shortest=12)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                              r["period"].cast("string")), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults that the checksum of a row's id and turn names."""
    from .repair import conversation_rows

    rows = conversation_rows(conversations, "conv_id", "turn", "role", "text")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("h", F.crc32(name.cast("binary")) % 20).filter("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def written_hashes(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of `role:text` lines in order. SHA-256 runs along a conversation, text by text."""
    import hashlib

    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def hashing(batches):
        conv, state = object(), None
        for batch in batches:
            done = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], schema.field(k).type) for k in (0, 1)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], schema=schema)

    rows = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text")
    return rows.mapInArrow(hashing, "conv_id long, repaired_sha256 string")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repair, same

    rows = table(spark, sf_dir, "conversations")
    report, repaired = repair(damaged(rows))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (report, written_hashes(repaired)):
        part = part.withColumnRenamed("conv_id", "conv_id_")
        out = out.join(part, same(out, part, ["conv_id"]), "left").drop("conv_id_")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
