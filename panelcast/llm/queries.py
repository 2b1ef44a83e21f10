"""Registered queries of the corpus operators: each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe, html_extract, langid, merkle, toxicity, warc
from panelcast.llm.jaccard import jaccard_components
from panelcast.llm.mixing import mix_plan
from panelcast.llm.quality import quality_verdicts
from panelcast.llm.resample import resample
from panelcast.llm.rlz import remove_repeats
from panelcast.llm.sharding import shard_by_bytes
from panelcast.llm.stream_dedup import deduplicate
from panelcast.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

#: Vocabulary of the byte-level BPE query; a path that every executor has.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back in byte ranges."""
    folder, _ = warc.write_archives(_pages(spark, sf_dir))
    records = warc.read_archives(spark, folder, with_payload=False)
    return records.select(
        warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("refers_to")
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a string-kernel classifier fitted on three quarters of the ids."""
    docs = _documents(spark, sf_dir)
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out")
    model = langid.fit(docs.where(~F.coalesce(held_out, F.lit(False))), F.xxhash64("doc_id", "text"))
    texts = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return langid.identify(texts, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles agree to three quarters."""
    return jaccard_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the bytes they decode to, as digests."""
    rows = bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), RANKS, PATTERN, back=True)
    n = (F.octet_length("_ids") / 4).cast("bigint").alias("n_tokens")
    return rows.select("doc_id", n, F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of rules whose cutoffs are certified on the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_verdicts(_documents(spark, sf_dir), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curriculum mix of all sources, in order of the first training position."""
    plan = mix_plan(_documents(spark, sf_dir), ["doc_id"])
    first = F.when(F.size("positions") > 0, F.array_min("positions")).alias("position")
    rows = plan.select("_doc.doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "taken", first)
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op7_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies, A-Z folded, by a stateful stream over the documents; the largest id stays."""
    rows = deduplicate(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of nearly equal bytes by sampled splitters."""
    rows = shard_by_bytes(_documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the words of 35-word windows that start anywhere else too."""
    rows = remove_repeats(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by boosted trees over their elements."""
    pages = _pages(spark, sf_dir)
    texts = html_extract.extract(pages.select("page_id", "url", "html"), html_extract.fit(pages))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and roots of all documents, and what the proofs say of rows tampered with."""
    docs, config = _documents(spark, sf_dir), merkle.MerkleConfig()
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = [F.col(c) + 1 if c == "n_chars" else c for c in config.columns]
    m = merkle.manifest(docs, config, altered=F.when(tampered, merkle.leaf_digest(changed)))
    if m is None:
        return spark.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    again = merkle.folded(F.coalesce("altered", "leaf"), F.col("path"))
    rows = merkle.proofs(m).select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from confirmed toxic and unlabelled ones of four fifths of the ids."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    return toxicity.score(texts, model).select("doc_id", "held_out", "score", "predicted")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark texts by exact hashed-word weights and seeded noise."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(_documents(spark, sf_dir), benchmark).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc, op2_language_id, op3_jaccard_join, op4_byte_bpe, op5_quality_rules,
        op6_source_mixing, op7_stream_dedup, op8_sharding, op9_substring_dedup, op10_html_text,
        op11_merkle, op12_toxicity, op13_resample,
    )
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


_NIBBLES = "['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']"
_BITS = f"list_aggregate(list_transform(string_split(sha1(payload), ''), lambda h: {_NIBBLES}[instr('0123456789abcdef', h)]), 'string_agg', '')"
_FIVE = "substr(bits, 5 * i + 1, 5)"
_VALUE = " + ".join(f"CAST(substr({_FIVE}, {k + 1}, 1) AS INTEGER) * {16 >> k}" for k in range(5))

#: CRC-32 in SQL: the byte table by its rule, then one step a byte of the text ``x`` of the rows ``FROM``.
_CRC_TABLE = """crc_step AS (SELECT range AS n, 0 AS k, range AS c FROM range(256)
          UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
        crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_step WHERE k = 8)"""


def _crc(x: str) -> str:
    """CRC-32 of a text column, where ``crc_table`` is joined."""
    octets = f"list_transform(range(strlen({x})), lambda i: CAST('0x' || substr(hex({x}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda a, b: xor(t[xor(a, b) % 256 + 1], a >> 8)), 4294967295)"


def _field(x: str) -> str:
    """A value as it enters a leaf."""
    return f"(CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END)"


#: The digests one level up, in runs of two.
_RUNS = "list_transform(range((len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))"

#: DuckDB SQL that gives the same rows, where SQL can express the query.
SQL: dict[str, str] = {
    "op1_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        b AS (SELECT page_id, payload, {_BITS} AS bits, min(page_id) OVER (PARTITION BY payload) AS least FROM p)
        SELECT page_id, strlen(payload) AS payload_bytes,
          list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {_VALUE} + 1, 1)), 'string_agg', '') AS payload_digest,
          CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM b""",
    "op3_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_words(_FOLD)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g FROM w),
        n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY ALL),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        linked AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
        reach AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.seen = e.a)
        SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY ALL""",
    "op7_stream_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLD} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op9_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        dup AS (SELECT doc_id, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM dup),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
        kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.j) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY word.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_merkle": f"""
        WITH RECURSIVE {_CRC_TABLE},
        f AS (SELECT doc_id, lang, n_chars, {_field("doc_id")} || {_field("source")} || {_field("lang")} AS a, {_field("text")} AS b,
          {_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS tampered FROM documents, crc_table),
        leaf AS (SELECT doc_id, lang, sha256(a || {_field("n_chars")} || b) AS leaf,
          CASE WHEN tampered THEN sha256(a || {_field("(n_chars + 1)")} || b) ELSE sha256(a || {_field("n_chars")} || b) END AS changed FROM f),
        level AS (SELECT lang, 0 AS l, list(leaf ORDER BY doc_id) AS h FROM leaf GROUP BY lang
          UNION ALL SELECT lang, l + 1, {_RUNS} FROM level WHERE len(h) > 1),
        sub AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM level WHERE len(h) = 1),
        upper AS (SELECT 0 AS l, list(subroot ORDER BY pos) AS h FROM sub UNION ALL SELECT l + 1, {_RUNS} FROM upper WHERE len(h) > 1),
        spot AS (SELECT doc_id, lang, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM leaf),
        height AS (SELECT lang, max(l) AS height FROM level GROUP BY lang),
        step AS (SELECT spot.doc_id, l, (pos >> l) % 2 = 1 AS is_right, coalesce(h[xor(pos >> l, 1) + 1], '') AS s
          FROM spot JOIN level ON spot.lang IS NOT DISTINCT FROM level.lang AND len(h) > 1
          UNION ALL SELECT spot.doc_id, height + upper.l, (sub.pos >> upper.l) % 2 = 1, coalesce(h[xor(sub.pos >> upper.l, 1) + 1], '')
          FROM spot JOIN sub ON spot.lang IS NOT DISTINCT FROM sub.lang JOIN height ON spot.lang IS NOT DISTINCT FROM height.lang, upper WHERE len(h) > 1),
        path AS (SELECT doc_id, list({{'r': is_right, 's': s}} ORDER BY l) AS p FROM step GROUP BY doc_id),
        fold AS (SELECT spot.doc_id, p, 1 AS i, changed AS x FROM spot LEFT JOIN path USING (doc_id)
          UNION ALL SELECT doc_id, p, i + 1, sha256(CASE WHEN p[i].r THEN p[i].s || x ELSE x || p[i].s END) FROM fold WHERE i <= len(p)),
        final AS (SELECT doc_id, x, sha256(coalesce(list_aggregate(list_transform(p, lambda e: e.s), 'string_agg', ''), '')) AS proof FROM fold WHERE i = coalesce(len(p), 0) + 1)
        SELECT spot.doc_id, leaf, subroot, u.h[1] AS root, proof AS proof_sha256, x AS folded_root, x = u.h[1] AS verified
        FROM spot JOIN sub ON spot.lang IS NOT DISTINCT FROM sub.lang JOIN final USING (doc_id), (SELECT h FROM upper WHERE len(h) = 1) u""",
    "op13_resample": f"""
        WITH RECURSIVE {_CRC_TABLE},
        d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        dw AS (SELECT doc_id, unnest(w) AS x FROM d), bw AS (SELECT unnest(w) AS x FROM b),
        words AS (SELECT x, CAST({_crc("x")} AS BIGINT) % 10000 AS bucket FROM (SELECT x FROM dw UNION SELECT x FROM bw), crc_table),
        s AS (SELECT bucket, count(*) AS s FROM dw JOIN words USING (x) GROUP BY ALL),
        t AS (SELECT bucket, count(*) AS t FROM bw JOIN words USING (x) GROUP BY ALL),
        g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM dw) + 10000)) /
          (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS g
          FROM (SELECT DISTINCT bucket FROM words) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
        weighed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN words USING (x) JOIN g USING (bucket) GROUP BY ALL),
        scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) +
          CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
          FROM d LEFT JOIN weighed USING (doc_id)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r,
          10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= n THEN r END AS rank FROM ranked""",
}
