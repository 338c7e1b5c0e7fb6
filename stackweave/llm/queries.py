"""The registered queries of this package: (spark, folder of the tables) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fill_middle, fingerprints, jaccard, language, lines, prefix_trie, quality, scratch, secrets, sentencepiece_viterbi, substrings, tokens, toxicity
from .learning import held_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    score = F.round("quality_score", 9)
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), "n_passages", "top_passage")


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link(table(spark, folder, "documents").select("doc_id", "text"), jaccard.Rule(3, 90, 100))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Contaminated documents only: a row per document and benchmark item."""
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, folder, "documents").select("doc_id", "text")).drop("spans")


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, folder, "documents").select("doc_id", "text"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    score = F.round("toxic_score", 9)
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst_start", "worst_end", spans.alias("offending"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH line AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT doc_id, pos, line, coalesce(first < doc_id, false) AS dropped
  FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k AND length(keyed.k) >= 10
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; each machine of the cluster has it installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its ids, and whether they decode to the text."""
    model = tokenizer_file("piece_bpe_32k.model")
    back = sentencepiece_viterbi.round_trip(table(spark, folder, "documents").select("doc_id", "text"), model)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "\u2581", " ")
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op9_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch.place(spark, "tokens")
    tokens.write(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), out)
    got = tokens.checksums(tokens.read(spark, out)).join(tokens.starts_of(spark, out), "part")
    return got.select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    out = secrets.summary(table(spark, folder, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "n_live", "n_example", F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


OP11_SQL = """
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)
), turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT c, list(turn ORDER BY pos) AS ts FROM turns GROUP BY c),
started AS (
  SELECT o.c, o.ts, coalesce(b.ts, []) AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(length(CAST(o.c AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(o.c AS VARCHAR), i + 1, 1)) AS BIGINT))),
                         lambda a, x: xor(a // 256, crc.t[xor(a % 256, x) + 1])), 4294967295) % 4 AS h
  FROM crc, own o LEFT JOIN own b ON b.c = o.c - o.c % 20
), whole AS (SELECT c, list_concat(base[1:h], ts[h + 1:]) AS ts FROM started),
visits AS (SELECT c, len(ts) AS n, d, ts[1:d] AS path FROM (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM whole)),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM visits GROUP BY path, d
), kids AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
own_totals AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON nodes.path = kids.path),
sums AS (
  SELECT path[1:up] AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(range(d + 1)) AS up FROM own_totals) GROUP BY 1
)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own_totals o JOIN sums s ON o.path = s.path LEFT JOIN nodes p ON o.d > 0 AND p.path = o.path[1:o.d - 1]
"""


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    out = fill_middle.transform(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


OP12_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS hex,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), ranks AS (
  SELECT *, len(u) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(hex, 8 * i + 1, 8) AS BIGINT)) AS h FROM units
), cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM ranks
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    out = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_sentencepiece, op3_ngram_jaccard, op4_decontamination, op5_suffix_array_dedup, op8_fingerprints, op6_toxicity, op7_line_dedup, op9_token_binary, op10_secret_scans, op11_prefix_trie, op12_fill_middle, op13_language_id)}
SQL = {"op7_line_dedup": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_fill_middle": OP12_SQL}
