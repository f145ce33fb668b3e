"""The registered queries of this subpackage and the SQL that checks them, where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletop.llm import (
    bpe,
    embedding_dedup,
    fingerprints,
    hard_negatives,
    jaccard_join,
    language_id,
    lm_scoring,
    mixing,
    phrase_index,
    quality,
    repeats,
    token_counts,
    warc,
)
from tabletop.llm.common import stored
from tabletop.plans.tables import table
from tabletop.session import working_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; a null id has the crc32 of the empty text, 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", remainder("doc_id", 5) == 0)
    model = language_id.train(docs.where("not held_out"))
    found = language_id.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, VOCABULARY, decoded="decoded")
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors."""
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Pseudo-likelihood of every document under a model of all of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lm_scoring.train_and_score(docs, keep_text=False)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labels of those that are not held out."""
    docs = quality.with_statistics(table(spark, folder, "documents").select("doc_id", "text"))
    docs = stored(docs.select("doc_id", "statistics"), "quality").withColumn("held_out", remainder("doc_id", 3) == 1)
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    rules = quality.train(docs.where("not held_out").join(labels, "doc_id"))
    scored = docs.select("doc_id", "held_out", rules.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as it is read back from the archives that were written for all of them."""
    where = working_folder(spark, "archives")
    archives = warc.write(table(spark, folder, "pages"), where)
    found = warc.read(spark, where, archives)
    number = lambda header: F.regexp_extract(F.col("headers")[header], r"^<urn:page:(-?\d+)>$", 1)
    http = F.substring(F.col("block").cast("string"), 1, 200)
    return found.select(
        number("warc-record-id").alias("n"), number("warc-refers-to").alias("refers"),
        F.regexp_extract(http, r"Content-Length: (\d+)\r\n", 1).cast("bigint").alias("payload_bytes"),
        F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
    ).select(
        F.expr("nullif(n, '')").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("nullif(refers, '')").cast("bigint").alias("refers_to"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    _, taken = mixing.mix(table(spark, folder, "documents"))
    return mixing.taken_words(taken)


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its successor."""
    return fingerprints.with_next(table(spark, folder, "documents").select("doc_id", "text"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy longest-match tokens of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, VOCABULARY).select("doc_id", "n_words", "n_tokens")


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stand in windows of test items, and the items whose windows occur."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = phrase_index.contamination(docs, table(spark, folder, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"))


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of words of every document, one in ten of which is made periodic before; a null id leaves its text as it is."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda word: word != "")
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    docs = docs.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    docs = docs.withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr(
        "concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int(ceil((n - a) / p)))), 1, int(n - a)))")
    edited = F.when(F.col("n") > 0, F.array_join(periodic, " ")).otherwise(F.col("text"))
    found = repeats.collapse(docs.select("doc_id", edited.alias("text")), keep_text=False)
    run = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listed = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", run.alias("run"), F.array_join(listed, "").alias("listed"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("run.col2")).alias("start"),
        F.col("run.length").alias("length"), (-F.col("run.col3")).alias("period"),
        F.expr("1000 * run.length div -run.col3").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every anchor and its positives; one row in seven has another label."""
    rows = table(spark, folder, "embeddings")
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.transform("embedding", lambda x: F.when(finite(x), F.floor(x.cast("double") * 256)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select(
        "vec_id", label.alias("label"), whole.alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_fingerprints": op9_fingerprints,
    "op10_token_counts": op10_token_counts,
    "op11_decontamination": op11_decontamination,
    "op12_runs": op12_runs,
    "op13_hard_negatives": op13_hard_negatives,
}
# SQL for those whose rows it can tell, by comparing all pairs; the others are tested against plain code.
CHECKS: dict[str, str] = {
    "op3_embedding_dedup": """
        WITH RECURSIVE sound AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
          SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
        reach(node, other) AS (
          SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.other)
        SELECT e.vec_id, (SELECT COUNT(*) FROM links l WHERE l.x = e.vec_id) AS n_links, c.component_id,
               e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN (SELECT node, MIN(other) AS component_id FROM reach GROUP BY node) c ON c.node = e.vec_id""",
    "op6_warc": """
        WITH raw AS (
          SELECT page_id, COALESCE(html, '') AS html, MAX(page_id) OVER (PARTITION BY COALESCE(html, '')) AS first FROM pages),
        hashed AS (SELECT *, sha1(html) AS h FROM raw)
        SELECT page_id, strlen(html) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                 (CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INT))) & 31 AS INT), 1)), '')
                 AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM hashed""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
        grams AS (
          SELECT DISTINCT doc_id, unnest(list_transform(
            range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 4, 1) + 1 END), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
          FROM words),
        sizes AS (SELECT doc_id, COUNT(*) AS n FROM grams GROUP BY doc_id),
        common AS (
          SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY 1, 2),
        links AS (
          SELECT x, y FROM common c JOIN sizes a ON a.doc_id = c.x JOIN sizes b ON b.doc_id = c.y
          WHERE 5 * c.n >= 4 * (a.n + b.n - c.n)),
        reach(node, other) AS (
          SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.other)
        SELECT d.doc_id, c.class_id, (SELECT COUNT(*) FROM links l WHERE l.x = d.doc_id) AS n_links
        FROM documents d JOIN (SELECT node, MIN(other) AS class_id FROM reach GROUP BY node) c ON c.node = d.doc_id""",
    # A proximity match is looked for where the rarest word of its window stands: it must be there whatever word one starts from.
    "op11_decontamination": r"""
        WITH doc_lists AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        item_lists AS (
          SELECT COALESCE(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_split_to_array(translate(COALESCE(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
          FROM benchmark),
        doc_words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM doc_lists),
        counts AS (SELECT word, COUNT(*) AS n FROM doc_words GROUP BY word),
        windows AS (
          SELECT item, pos, list_slice(w, pos, pos + least(len(w), 10) - 1) AS words
          FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS pos FROM item_lists WHERE len(w) > 0)),
        places AS (
          SELECT item, pos, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS k, len(words) AS size FROM windows),
        ranked AS (
          SELECT p.*, c.n, row_number() OVER (PARTITION BY item, pos ORDER BY c.n, p.word, k) AS rank,
                 COUNT(c.n) OVER (PARTITION BY item, pos) AS known FROM places p LEFT JOIN counts c ON c.word = p.word),
        starts AS (
          SELECT DISTINCT r.item, r.pos, r.size, d.doc_id, d.i - r.k + s.step AS start
          FROM ranked r JOIN doc_words d ON d.word = r.word, (SELECT unnest(range(-2, 3)) AS step) s WHERE r.rank = 1 AND r.known = r.size),
        met AS (
          SELECT s.item, s.pos, s.size, s.doc_id, s.start, COUNT(DISTINCT p.k) AS near, COUNT(DISTINCT p.k) FILTER (d.i = s.start + p.k) AS exact
          FROM starts s JOIN places p ON p.item = s.item AND p.pos = s.pos
          JOIN doc_words d ON d.doc_id = s.doc_id AND d.word = p.word AND d.i BETWEEN s.start + p.k - 2 AND s.start + p.k + 2
          GROUP BY ALL),
        hits AS (
          SELECT doc_id, COUNT(DISTINCT i) AS n_hit
          FROM (SELECT doc_id, unnest(range(start, start + size)) AS i FROM met WHERE exact = size) GROUP BY doc_id),
        near AS (SELECT doc_id, COUNT(DISTINCT item) AS n FROM met WHERE near = size GROUP BY doc_id),
        named AS (
          SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM met WHERE exact = size) GROUP BY doc_id)
        SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
               sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated, COALESCE(n.n, 0) AS n_near_items
        FROM doc_lists l LEFT JOIN hits h ON h.doc_id = l.doc_id LEFT JOIN named i ON i.doc_id = l.doc_id LEFT JOIN near n ON n.doc_id = l.doc_id""",
    "op12_runs": r"""
        WITH raw AS (
          SELECT doc_id, list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '') AS w,
                 CAST(doc_id AS VARCHAR) AS s FROM documents),
        -- crc32 of the decimal id: byte by byte, bit by bit.
        hashed AS (
          SELECT *, len(w) AS n, xor(list_reduce(
            list_prepend(4294967295, list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))),
            4294967295) AS h FROM raw),
        shaped AS (
          SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
        cut AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM shaped),
        edited AS (
          SELECT doc_id, n, CASE WHEN a IS NULL THEN w
            ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM cut),
        words AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM edited),
        equal AS (
          SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word
          WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
        stretches AS (
          SELECT doc_id, q, MIN(i) AS start, COUNT(*) + q AS length FROM islands GROUP BY doc_id, q, island),
        runs AS (
          SELECT doc_id, start, length, MIN(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
        best AS (
          SELECT doc_id, COUNT(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed,
                 first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS run
          FROM runs GROUP BY doc_id),
        kept AS (
          SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words
          WHERE NOT EXISTS (
            SELECT 1 FROM runs WHERE runs.doc_id = words.doc_id AND i >= start + period AND i < start + length) GROUP BY doc_id)
        SELECT e.doc_id, COALESCE(n_runs, 0) AS n_runs, run.start AS start, run.length AS length, run.period AS period,
               1000 * run.length // run.period AS exponent_milli, sha256(COALESCE(listed, '')) AS runs_sha256,
               sha256(COALESCE(k.text, '')) AS collapsed_sha256
        FROM edited e LEFT JOIN best b ON b.doc_id = e.doc_id LEFT JOIN kept k ON k.doc_id = e.doc_id""",
    "op13_hard_negatives": """
        WITH sound AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
          FROM sound a JOIN sound b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
        positives AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        ranked AS (
          SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
          FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
          WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= 3""",
}
