"""Registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenline.llm import licences, mixing, neardup, neighbours, packing, quality, ranking, secrets, suffixes, threshold, tokens, toxicity, trie
from screenline.sources.tables import read_table

TOKEN_LIMIT = 4096


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts, and how much of each fits the limit."""
    counts = tokens.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), budget=TOKEN_LIMIT)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One epoch in which every source has the same share of the characters."""
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of whole texts that earlier strings of 100 bytes cover."""
    found = suffixes.drop_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of whole texts, by kind, with digests of their places."""
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    place = lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(F.transform(base, place), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", place), ",").alias("spans"), count("random"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of whole documents as sequences."""
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector, among all others."""
    found = neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumn("rank", F.col("rank").cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and risk-controlled cutoffs per language."""
    judged = quality.judge_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.array_join("failed_rules", ",").alias("failed_rules"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of whole texts; flagged goes by the language's threshold, predicted by 0.7."""
    found = toxicity.detect_toxic(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", toxicity.is_held_out().alias("held_out"), F.col("toxic_score").alias("score"),
                        (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"), "flagged", "threshold")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate whole texts."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of whole texts."""
    found = licences.find_licences(read_table(spark, sf_dir, "documents"))
    return found.withColumn("licences", F.array_join("licences", ","))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    found = ranking.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("rank", F.col("rank").cast("int"))


def op12_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector, among all others."""
    found = threshold.top_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumn("rank", F.col("rank").cast("int"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations."""
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_mixing, op3_repeats, op4_secrets, op5_packing, op6_neighbours, op7_quality, op8_toxicity, op9_near_duplicates, op10_licences,
                             op11_ranking, op12_products, op13_prefix_trie)
}

def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _templates(threshold: float = 0.8) -> str:
    rows = []
    for i, (name, text) in enumerate(licences.TEMPLATES):
        own = licences.template_bigrams(text)
        low, high = licences.bounds(len(own), threshold)
        rows.append(f"({i}, {_s(name)}, [{', '.join(map(_s, own))}], {len(own)}, {low}, {high}, {len(licences.template_words(text))})")
    return ", ".join(rows)


ORACLE: dict[str, str] = {
    "op2_mixing": """WITH sizes AS (SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS size FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE * 1.0::DOUBLE * (SELECT sum(size) FROM sizes)::DOUBLE / size::DOUBLE AS rate FROM sizes),
means AS (SELECT source, draws, rate / draws AS mean FROM (SELECT *, ceil(greatest(ceil(rate), 1) / 4)::INTEGER AS draws FROM rates)),
terms AS (SELECT source, draws, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM (SELECT *, unnest(range(0, 40)) AS k FROM means)),
below AS (SELECT source, draws, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
cuts AS (SELECT source, any_value(draws) AS draws, list(c) AS cuts FROM below GROUP BY source),
who AS (SELECT d.*, 'mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null') AS name FROM documents d),
drawn AS (SELECT w.*, list_sum(list_transform(range(1, draws + 1), lambda i:
    len(list_filter(cuts, lambda c: c <= ('0x' || substr(md5(name || '|draw|' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))))::INTEGER AS copies
  FROM who w JOIN cuts c ON w.source IS NOT DISTINCT FROM c.source),
each AS (SELECT *, unnest(range(1, copies + 1))::INTEGER AS mix_copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, mix_copy, md5(name || '|' || mix_copy) AS mix_order FROM each""",
    "op10_licences": f"""WITH templates(i, name, own, n, low, high, words) AS (VALUES {_templates()}),
low AS (SELECT doc_id, translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}') AS t FROM documents),
units AS (SELECT doc_id, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\\n[ \\t]*\\n'))) AS unit FROM low),
words AS (SELECT doc_id, string_split(trim(regexp_replace(unit, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
bags AS (SELECT DISTINCT doc_id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS bag FROM words
  WHERE len(w) > (SELECT min(low) FROM templates)),
hits AS (SELECT doc_id, i, name, 2.0::DOUBLE * len(list_intersect(bag, own)) / (len(bag) + n) AS score
  FROM bags JOIN templates ON len(bag) BETWEEN low AND high),
runs AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS run
  FROM (SELECT doc_id, string_split(trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM low)),
places AS (SELECT doc_id, len(run) AS last, unnest(run) AS pair, unnest(range(1, len(run) + 1)) AS seat FROM runs),
shared AS (SELECT doc_id, i, words, last, pair, seat FROM places JOIN (SELECT i, words, unnest(own) AS pair FROM templates) USING (pair) WHERE last >= words - 1),
starts AS (SELECT DISTINCT doc_id, i, words, unnest(range(greatest(1, seat - words + 2), least(seat, last - words + 2) + 1)) AS start FROM shared),
common AS (SELECT s.doc_id, s.i, s.words, s.start, count(DISTINCT h.pair) AS c FROM starts s JOIN shared h ON h.doc_id = s.doc_id AND h.i = s.i
  AND h.seat BETWEEN s.start AND s.start + s.words - 2 GROUP BY ALL),
windows AS (SELECT doc_id, i, name, max(2.0::DOUBLE * c / (len(list_distinct(run[start:start + words - 2])) + n)) AS score
  FROM (SELECT * EXCLUDE (words) FROM common) JOIN templates USING (i) JOIN runs USING (doc_id) WHERE c >= low GROUP BY ALL),
good AS (SELECT *, 1 AS unit FROM hits WHERE score >= 0.8 UNION ALL SELECT *, 0 FROM windows WHERE score >= 0.8),
names AS (SELECT doc_id, string_agg(name, ',' ORDER BY seat) AS licences FROM (SELECT doc_id, name, min(i) AS seat FROM good GROUP BY doc_id, name) GROUP BY doc_id),
best AS (SELECT doc_id, name, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r, sum(unit) OVER (PARTITION BY doc_id) AS n,
  sum(1 - unit) OVER (PARTITION BY doc_id) AS m FROM good)
SELECT d.doc_id, coalesce(licences, '') AS licences, name AS best, round(score, 6) AS best_score, coalesce(n, 0)::INTEGER AS n_units, coalesce(m, 0)::INTEGER AS n_windows
FROM documents d LEFT JOIN names USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.doc_id = d.doc_id""",
    "op11_ranking": """WITH cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]|[^\x00-\x7F]') AS z,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '') AS terms FROM documents),
docs AS (SELECT doc_id, row_number() OVER () AS r, len(terms)::BIGINT AS n, terms FROM cut WHERE len(terms) > 0 AND doc_id IS NOT NULL),
whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
counted AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM counted GROUP BY term),
weighed AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM dfs, whole),
wanted AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
items AS (SELECT item_id, term, count(*)::BIGINT AS c FROM wanted GROUP BY item_id, term),
scored AS (SELECT item_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l)))))::BIGINT AS score
  FROM items JOIN weighed USING (term) JOIN counted USING (term) JOIN docs USING (r), whole GROUP BY item_id, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op12_products": """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op13_prefix_trie": """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
crcs AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)) + y)), 4294967295::BIGINT) % 4 AS h FROM lists),
built AS (SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS s
  FROM crcs c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 20),
seqs AS (SELECT s, count(*) AS n, min(conv_id) AS least, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM built GROUP BY s),
steps AS (SELECT s, n, least, unnest(range(0, len(s) + 1)) AS depth FROM seqs),
nodes AS (SELECT depth, list_slice(s, 1, depth) AS p, min(least) AS conv_id, sum(n)::BIGINT AS n_convs FROM steps GROUP BY ALL),
kids AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
saves AS (SELECT depth, p, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[depth].text, '[^\x20\x09-\x0D]+')) END AS saved,
  CASE WHEN p IN (SELECT p FROM kids) THEN 0 ELSE 1 END AS leaf FROM nodes),
above AS (SELECT list_slice(p, 1, d) AS p, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves
  FROM (SELECT p, saved, leaf, unnest(range(0, depth + 1)) AS d FROM saves) GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, a.n_leaves, a.saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM nodes n JOIN above a ON a.p = n.p LEFT JOIN kids k ON k.p = n.p LEFT JOIN seqs e ON e.s = n.p
LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = list_slice(n.p, 1, n.depth - 1)""",
}
