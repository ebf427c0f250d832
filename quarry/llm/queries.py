"""The queries of this subpackage: each applies its operator, with production parameters, to the whole table.

Four more show those columns of an operator's result that SQL can express, beside that SQL. What it can't: models' scores,
tokenizers, XXH64, edit distances, and chains of matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import quality_cnn

    return quality_cnn.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import decontaminate

    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import token_counts

    return token_counts.count(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import toxicity_mil

    return toxicity_mil.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import substring_dedup

    return substring_dedup.digests(_read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import license_scan

    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import class_lm

    return class_lm.score(_read(spark, sf_dir, "documents"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import winnow

    return winnow.edit_likeness(_read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import packing

    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import simhash

    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import prefix_trie

    return prefix_trie.trie(_read(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import bpe

    return bpe.digests(_read(spark, sf_dir, "documents"))


def op13_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import branch_merge

    return branch_merge.digests(_read(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of LM scoring what follows from the corpus's counts alone."""
    return op7_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of license scans the places of the base phrases."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of document fingerprints the edited texts."""
    return op8_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


_WORDS = "list_filter(string_split_regex({}, '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc(text: str) -> str:
    """CRC-32, bit by bit, of an ASCII text."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""


_CRC = _crc("doc_id::VARCHAR")


def _phrases() -> str:
    from quarry.llm.license_scan import PHRASES

    def one(phrase: str, label: str) -> str:
        words = phrase.split()
        return f"list_transform(list_filter(range(1, len(w) - {len(words) - 2}), lambda i: w[i:i + {len(words) - 1}] = {words}), lambda i: {{'at': i - 1, 'label': '{label}'}})"

    return "list_concat(" + ", ".join(one(p, label) for p, label in PHRASES.items()) + ")"


def _merge_sql() -> str:
    """Each unit's codes side by side; a code under 3 changes a line, 3 and 4 fill the gap behind it."""
    code = lambda branch, name: f"{_crc(f"'{branch}:' || doc_id || ':' || {name}")} % 17"
    both = lambda name, to: f"{code('L', name)} AS l{to}, {code('R', name)} AS r{to}"
    column = lambda c, k: f"CASE {k}{c[0]} WHEN 0 THEN '' WHEN 1 THEN {c} || '!' WHEN 2 THEN {c} || '?' ELSE {c} END AS {k}_{c}"
    merged = lambda c: f"CASE WHEN l_{c} <> {c} OR rr = 0 THEN l_{c} ELSE r_{c} END AS {c}"
    counts = lambda c: f"((l_{c} <> {c} OR r_{c} <> {c}) AND (l_{c} = {c} OR r_{c} = {c} OR l_{c} = r_{c}))::INT", lambda c: f"(l_{c} <> {c} AND r_{c} <> {c} AND l_{c} <> r_{c})::INT"
    return f"""WITH b AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT *, {both("'row'", "r")}, {both("'lang'", "l")}, {both("'source'", "s")} FROM b),
d AS (SELECT *, {column("lang", "l")}, {column("lang", "r")}, {column("source", "l")}, {column("source", "r")} FROM c),
t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM b),
u AS (SELECT t.doc_id, v, i, {both("i", "").replace("doc_id", "t.doc_id")}, rr FROM t JOIN (SELECT doc_id, rr FROM c) x ON x.doc_id = t.doc_id),
w AS (SELECT *, CASE WHEN l < 3 THEN l WHEN r < 3 AND rr <> 0 THEN r END AS e, CASE WHEN l IN (3, 4) THEN l WHEN r IN (3, 4) AND rr <> 0 THEN r END AS g FROM u),
s AS (SELECT doc_id, list(CASE WHEN e = 0 THEN [] WHEN e = 1 THEN [v || '!'] WHEN e = 2 THEN [v || '?'] ELSE [v] END || CASE g WHEN 3 THEN ['!'] WHEN 4 THEN ['?'] ELSE [] END ORDER BY i) AS parts,
  count(*) FILTER ((l < 3 OR r < 3) AND (l >= 3 OR r >= 3 OR l = r)) + count(*) FILTER ((l IN (3, 4) OR r IN (3, 4)) AND (l NOT IN (3, 4) OR r NOT IN (3, 4) OR l = r)) AS clean,
  count(*) FILTER (l < 3 AND r < 3 AND l <> r AND l > 0 AND r > 0) AS ee, count(*) FILTER (l < 3 AND r < 3 AND l <> r AND (l = 0 OR r = 0)) AS ed, count(*) FILTER (l IN (3, 4) AND r IN (3, 4) AND l <> r) AS ii,
  bool_or(l < 5) AS l_lines, bool_or(r < 5) AS r_lines FROM w GROUP BY doc_id),
k AS (SELECT d.doc_id, {merged("lang")}, {merged("source")}, array_to_string(flatten(parts), chr(10)) AS text, lr = 0 OR rr = 0 AS drop, lr = 0 AS l_drop,
  (lr <> 0 AND (l_lines OR l_lang <> lang OR l_source <> source)) OR (rr <> 0 AND (r_lines OR r_lang <> lang OR r_source <> source)) AS kept_changed,
  clean + {counts[0]("lang")} + {counts[0]("source")} AS clean, ee + {counts[1]("lang")} + {counts[1]("source")} AS ee, ed, ii FROM d JOIN s ON s.doc_id = d.doc_id),
a AS (SELECT -1 - doc_id AS doc_id, 'L' AS branch, lang, source, CASE lr WHEN 3 THEN '!' ELSE '?' END AS text FROM c WHERE lr IN (3, 4)
  UNION ALL SELECT -5 - doc_id, 'R', lang, source, CASE rr WHEN 3 THEN '!' ELSE '?' END FROM c WHERE rr IN (3, 4)),
n AS (SELECT doc_id, arg_min(lang, branch) AS lang, arg_min(source, branch) AS source, arg_min(text, branch) AS text, (count(DISTINCT {{'a': lang, 'b': source, 'c': text}}) > 1)::BIGINT AS ii FROM a GROUP BY doc_id)
SELECT doc_id, CASE WHEN NOT gone THEN lang END AS lang, CASE WHEN NOT gone THEN source END AS source, CASE WHEN NOT gone THEN sha256(text) END AS text_sha256,
  CASE WHEN drop THEN (NOT kept_changed)::INT ELSE clean END AS n_clean, CASE WHEN drop THEN 0 ELSE ee END AS n_edit_edit, CASE WHEN drop THEN kept_changed::INT ELSE ed END AS n_edit_delete, CASE WHEN drop THEN 0 ELSE ii END AS n_insert_insert
FROM (SELECT *, drop AND (l_drop OR NOT kept_changed) AS gone FROM k)
UNION ALL SELECT doc_id, lang, source, sha256(text), 1 - ii, 0, 0, ii FROM n"""


SQL: dict[str, Callable[[], str]] = {
    "op13_branch_merge": _merge_sql,
    "op5_substring_dedup": lambda: f"""WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM t, unnest(range(1, len(w) - 11)) AS u(i)),
first AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (k) WHERE d < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id""",
    # A prefix's key is its turns as JSON. Sums over subtrees go over the pairs of a node and one below it.
    "op11_conversation_prefix_trie": lambda: f"""WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_crc("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS b FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN o ON o.conv_id = b AND i <= h UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
d AS (SELECT conv_id, row_number() OVER w AS depth, len({_WORDS.format("text")}) AS words, to_json(list({{'r': role, 't': text}}) OVER w)::VARCHAR AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
p AS (SELECT conv_id, depth, words, k, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM d UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
n AS (SELECT k, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT a.k, b.k AS low FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT below.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens FROM below JOIN n ON n.k = low LEFT JOIN kids ON kids.k = low GROUP BY below.k),
ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY conv_id) GROUP BY k)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n u ON u.k = n.up LEFT JOIN kids ON kids.k = n.k JOIN sums ON sums.k = n.k LEFT JOIN ends ON ends.k = n.k""",
    "lm_base_scores": lambda: f"""WITH t AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS.format(_LOWER)}, ' ') AS w FROM documents),
tok AS (SELECT doc_id, held_out, unnest(w) AS x FROM t),
c AS (SELECT x, count(*) AS c FROM tok WHERE NOT held_out GROUP BY x),
s AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1))), 5) AS base_score
FROM tok LEFT JOIN c USING (x), s GROUP BY doc_id""",
    "license_places": lambda: f"""WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {_phrases()} AS found FROM t)
SELECT doc_id, n_words, len(found) AS n_base, list_min(list_transform(found, lambda x: x.at)) AS first_word, list_max(list_transform(found, lambda x: x.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ',') AS base_labels FROM p""",
    "edited_texts": lambda: """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next FROM documents WINDOW w AS (ORDER BY doc_id DESC))
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 3) || left(next, length(text) // 3)) AS edited_sha256 FROM t""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") or name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: sql() for name, sql in SQL.items()}
