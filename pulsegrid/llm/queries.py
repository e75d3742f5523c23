"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, line_dedup, mixing, pii, quality, runs, sentencepiece, sharding, simhash, spelling, suffix_dedup, winnow
from .common import WORD

MAX_RATIO, MIN_PAGES = 0.1, 3
SHARDS, TABLE_SIZE = 16, 2039
MAX_LINE_RATIO, MIN_LINE_DOCS, MIN_LEFT = 0.1, 3, 0.8
MAX_EPOCHS = 2.0


def model_path() -> str:
    """The SentencePiece model: $PIECE_MODEL, else the installed public one."""
    if "PIECE_MODEL" in os.environ:
        return os.environ["PIECE_MODEL"]
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def vocabulary_path() -> str:
    """The byte-level BPE vocabulary: $BPE_VOCABULARY, else the installed public one."""
    if "BPE_VOCABULARY" in os.environ:
        return os.environ["BPE_VOCABULARY"]
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python `rows` at a time; with Spark's 10,000 a batch of long texts takes hundreds of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_docs(spark, sf_dir).select("doc_id", "source", "text"), "source", "text", MAX_RATIO, MIN_PAGES)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir).select("doc_id"), "doc_id", SHARDS, TABLE_SIZE)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_docs(spark, sf_dir), MAX_LINE_RATIO, MIN_LINE_DOCS, MIN_LEFT).drop("k1", "k2", "hit")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.sha2("text", 256).alias("sha256"))
    coded = sentencepiece.decode(sentencepiece.encode(docs, model_path(), keep_text=False), model_path())
    digest = F.sha2("decoded", 256)
    return coded.select("doc_id", "n_tokens", "tokens", digest.alias("decoded_sha256"), F.col("sha256").eqNullSafe(digest).alias("round_trip"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(_docs(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_docs(spark, sf_dir).select("doc_id", "source", "text"), max_epochs=MAX_EPOCHS)
    return planned.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), F.round("epochs", 6).alias("epochs"), "copies")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_docs(spark, sf_dir)).drop("kept")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_with_edits(_docs(spark, sf_dir))


def with_runs(docs: DataFrame) -> DataFrame:
    """`doc_id, text`: every tenth document by its id's checksum has words that repeat from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n, times = F.size("w"), (3 + F.col("g") % 8).cast("int")
    placed = split.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / times)).cast("int"))
    again = F.concat(F.slice("w", 1, F.col("a")), F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.slice(again, 1, n), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = runs.find_runs(with_runs(_docs(spark, sf_dir)))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("_"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    digests = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("r.length") / F.col("r.period")).alias("exponent_milli")
    return digests.select("doc_id", "n_words", "n_runs", "r.start", "r.length", "r.period", milli, "runs_sha256", "collapsed_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "word"))
    spot = (h % F.char_length("word")).cast("int")
    slipped = F.when(h % 199 == 0, F.concat(F.col("word").substr(F.lit(1), spot), F.col("word").substr(spot + 2, F.char_length("word")))).otherwise(F.col("word"))
    return spelling.group_variants(spelling.word_counts(_docs(spark, sf_dir).select("doc_id", "text"), slipped))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = bpe.encode(_docs(spark, sf_dir).select("doc_id", "text"), vocabulary_path(), packed="packed", keep_text=False)
    decoded = bpe.decode(coded.select("doc_id", "n_tokens", "tokens", F.sha2("packed", 256).alias("ids_sha256")), vocabulary_path())
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_sharding, op3_quality_rules, op4_sentencepiece, op5_pii, op6_mixing, op7_simhash, op8_suffix_dedup, op9_chat_format, op10_winnowing, op11_periodic_runs, op12_spelling_variants, op13_bpe)
}

_WORD = r"'[^\x20\x09-\x0D]+'"
_TRIM = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH d AS (SELECT doc_id, source, text, coalesce(source, '') AS host, string_split(text, chr(10)) AS ls,
                          row_number() OVER () AS r FROM documents),
        l AS (SELECT DISTINCT r, host, {_TRIM.format("x")} AS k FROM (SELECT r, host, unnest(ls) AS x FROM d)),
        pages AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
        bad AS (SELECT l.host, k FROM l JOIN pages USING (host) WHERE k <> '' GROUP BY l.host, k, pages
                HAVING count(*) >= {MIN_PAGES} AND count(*) > {MAX_RATIO}::DOUBLE * pages),
        f AS (SELECT host, list(k) AS ks FROM bad GROUP BY host),
        j AS (SELECT d.*, CASE WHEN ks IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(ks, {_TRIM.format("x")})) END AS kept
              FROM d LEFT JOIN f USING (host))
        SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
               CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines,
               CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(kept) END AS BIGINT) AS n_dropped FROM j""",
    "op2_sharding": f"""
        WITH RECURSIVE prefs AS (
          SELECT list(list_transform(range({TABLE_SIZE}), lambda j: (o + j * s) % {TABLE_SIZE}) ORDER BY i) AS p
          FROM (SELECT i, ('0x' || substr(md5('offset:shard-' || i), 1, 8))::BIGINT % {TABLE_SIZE} AS o,
                       ('0x' || substr(md5('skip:shard-' || i), 1, 8))::BIGINT % {TABLE_SIZE - 1} + 1 AS s
                FROM range({SHARDS}) t(i))),
        fill(n, t, slot) AS (
          SELECT 0, list_transform(range({TABLE_SIZE}), lambda k: -1), -1 FROM prefs
          UNION ALL
          SELECT n + 1, list_transform(t, lambda x, k: CASE WHEN k - 1 = c THEN n % {SHARDS} ELSE x END), c
          FROM (SELECT n, t, list_filter(p[n % {SHARDS} + 1], lambda c: t[c + 1] = -1)[1] AS c FROM fill, prefs WHERE n < {TABLE_SIZE})),
        slots AS (SELECT slot, (n - 1) % {SHARDS} AS shard FROM fill WHERE n > 0)
        SELECT doc_id, CAST(s.slot AS INTEGER) AS slot, CAST(s.shard AS INTEGER) AS shard
        FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {TABLE_SIZE} AS h FROM documents) d
        JOIN slots s ON s.slot = d.h""",
    "op3_quality_rules": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
        w AS (SELECT r, doc_id, host, t, regexp_extract_all(t, {_WORD}) AS ws, string_split(t, chr(10)) AS ls FROM d),
        g AS (SELECT r, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: {{'i': i, 'g': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]}})) AS x FROM w WHERE len(ws) >= 3),
        gc AS (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.g) AS n FROM g),
        rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM gc WHERE n > 1) GROUP BY r),
        l AS (SELECT r, host, unnest(ls) AS line FROM w),
        lw AS (SELECT r, host, line, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}), ' ') AS norm,
                      len(regexp_extract_all(line, {_WORD})) AS n FROM l),
        dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw WHERE n > 0 GROUP BY r),
        hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
        freq AS (SELECT lw.host, norm, count(DISTINCT d.t) AS n FROM lw JOIN d USING (r) WHERE n > 0 GROUP BY lw.host, norm),
        common AS (SELECT freq.host, norm FROM freq JOIN hosts USING (host) WHERE n >= {MIN_LINE_DOCS} AND n > {MAX_LINE_RATIO}::DOUBLE * docs),
        hit AS (SELECT r, sum(n) AS n FROM lw JOIN common USING (host, norm) GROUP BY r),
        m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                     CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                     CAST(coalesce(hit.n, 0) AS BIGINT) AS n_common_words
              FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN hit USING (r))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_common_words >= {MIN_LEFT}::DOUBLE * n_words AS kept FROM m""",
    "op6_mixing": f"""
        WITH d AS (SELECT doc_id, source, coalesce(source, '') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS n_tokens,
                          md5('0:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
        t AS (SELECT s, sum(n_tokens)::DOUBLE AS total FROM d GROUP BY s),
        p AS (SELECT s, total, total / sum(total) OVER () AS share FROM t),
        a AS (SELECT CASE WHEN max(share) = min(share) THEN 0 ELSE greatest(0, 1 - ln({MAX_EPOCHS}) / ln(max(share) / min(share))) END AS alpha FROM p WHERE share > 0),
        w AS (SELECT s, total, CASE WHEN share > 0 THEN pow(share, alpha) / (SELECT sum(pow(share, alpha)) FROM p, a WHERE share > 0) ELSE 0 END AS weight,
                     CASE WHEN share > 0 THEN round(pow((SELECT max(share) FROM p) / share, 1 - alpha), 9) ELSE 1 END AS epochs FROM p, a),
        c AS (SELECT d.*, weight, epochs, total, sum(n_tokens) OVER (PARTITION BY s ORDER BY o ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN w USING (s))
        SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, round(epochs, 6) AS epochs,
               CAST(floor(epochs) + CASE WHEN epochs > floor(epochs) AND cum <= floor(round((epochs - floor(epochs)) * total, 6)) THEN 1 ELSE 0 END AS BIGINT) AS copies
        FROM c""",
    "op9_chat_format": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
        e AS (SELECT *, regexp_replace(regexp_replace(replace(x, chr(92), chr(92) || chr(92)), '<(/?s>)', '<' || chr(92) || chr(92) || chr(92) || '1', 'g'),
                                       '[[](/?INST[]])', '[' || chr(92) || chr(92) || chr(92) || '1', 'g') AS esc
              FROM (SELECT *, text AS x FROM c))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(20 + length(role) + length(esc)) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_periodic_runs": r"""
        WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, hex(encode(doc_id::VARCHAR)) AS hx FROM documents),
        h AS (SELECT r, doc_id, ws, len(ws) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM d, t),
        a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        e AS (SELECT r, doc_id, n, list_transform(range(n), lambda i: ws[CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END + 1]) AS ws FROM p),
        g AS (SELECT r, n, unnest(range(n - 4)) AS i, unnest(list_transform(range(n - 4), lambda i: array_to_string(ws[i + 1 : i + 5], ' '))) AS gram FROM e WHERE n >= 6),
        m AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        s AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m) GROUP BY r, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
        u AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY ALL),
        l AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs, arg_max({'s': start, 'l': length, 'p': period}, {'l': length, 's': -start, 'p': -period}) AS best FROM u GROUP BY r),
        w AS (SELECT r, unnest(range(n)) AS i, unnest(ws) AS word FROM e),
        gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
        k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period, CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli,
               sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM e LEFT JOIN l USING (r) LEFT JOIN k USING (r)""",
    "op12_spelling_variants": """
        WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        w AS (SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS x FROM documents) WHERE length(x) >= 6 GROUP BY ALL),
        b AS (SELECT *, hex(encode(doc_id || ':' || w)) AS hx FROM w),
        h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM b, t),
        m AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM v, range(1, (SELECT max(length(word)) + 1 FROM v)) r(i) WHERE i <= length(word)),
        p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
          UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
        g AS (SELECT p.word, count(*) AS n_near, arg_min(near, {'n': -v.n, 'w': near}) AS near, max(v.n) AS near_n FROM p JOIN v ON v.word = p.near GROUP BY p.word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN g USING (word)),
        r AS (SELECT word, word AS root, form AS onward FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.onward)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM r WHERE onward IS NULL) USING (word)""",
}
