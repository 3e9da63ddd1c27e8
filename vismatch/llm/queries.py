"""The registered queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, lm_score, mixing, phrases, pii, quality, simhash, suffix_dedup, token_counts, token_files, vector_codes, warc


def pii_key() -> str:
    """The key of the pseudonyms: VISMATCH_PII_KEY, or one drawn anew, whose pseudonyms link within one result only."""
    return os.environ.get("VISMATCH_PII_KEY") or secrets.token_hex(32)


def tokenizer_file() -> str:
    """The vocabulary file: VISMATCH_TOKENIZER, or the one that the public_tokenizers package brings."""
    if found := os.environ.get("VISMATCH_TOKENIZER"):
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_vocabulary() -> str:
    """The vocabulary whose tokens are counted: VISMATCH_WORD_TOKENIZER, or the one that the public_tokenizers package brings."""
    if found := os.environ.get("VISMATCH_WORD_TOKENIZER"):
        return found
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.find_repeats(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge_documents(docs, quality.order_rules(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(_table(spark, sf_dir, "documents"), tokenizer_file())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(_table(spark, sf_dir, "documents"), pii_key())


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(_table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), word_vocabulary())


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT r, unnest(range(1, greatest(len(w) - 6, 1))) AS p, w FROM d),
h AS (SELECT r, array_to_string(list_slice(w, p, p + 7), ' ') AS win, list(p) AS ps FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT r, count(DISTINCT k) AS n_repeat FROM (SELECT r, unnest(range(p, p + 8)) AS k FROM (SELECT r, unnest(ps) AS p FROM h)) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
  len(list_filter(list_zip(w[:-2], w[2:]), lambda x: x[1] = x[2])) AS n_adjacent
  FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR n_upper > n_lower OR 5 * n_adjacent > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 40 * n_words) AS kept
FROM b"""

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, p, p + 9), ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS p FROM i)),
s AS (SELECT DISTINCT size FROM q),
g AS (SELECT r, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS win FROM (SELECT r, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS p FROM d CROSS JOIN s)),
f AS (SELECT g.r, g.p, g.size, q.item_id FROM g JOIN q ON g.size = q.size AND g.win = q.win),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS k FROM f) GROUP BY r),
t AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM f GROUP BY r),
z AS (SELECT f.r, f.item_id, f.p - q.p AS diag, f.p, f.size FROM f JOIN (SELECT item_id, least(len(w), 10) AS size, p, array_to_string(list_slice(w, p, p + 9), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS p FROM i)) q
  ON f.item_id = q.item_id AND f.size = q.size JOIN g ON g.r = f.r AND g.p = f.p AND g.size = f.size AND g.win = q.win),
y AS (SELECT r, item_id, diag, p, size, p - row_number() OVER (PARTITION BY r, item_id, diag ORDER BY p) AS island FROM (SELECT DISTINCT * FROM z)),
x AS (SELECT r, max(run) AS longest FROM (SELECT r, max(p) - min(p) + max(size) AS run FROM y GROUP BY r, item_id, diag, island) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r) LEFT JOIN x USING (r)"""

_OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, upper(sha1(payload)) AS hex FROM p),
b AS (SELECT *, list_transform(range(1, 41), lambda i: instr('0123456789ABCDEF', hex[i]) - 1) AS v FROM d),
e AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + (((v[1 + k * 5 // 4] * 16 + coalesce(v[2 + k * 5 // 4], 0)) >> (3 - (k * 5) % 4)) & 31), 1)), '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS largest FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM largest THEN NULL ELSE largest END AS refers_to FROM m"""

_OP11 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM g) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
s AS (SELECT lang, a AS longer, w, unnest(range(2, k)) AS size, k FROM c),
i AS (SELECT lang, longer, array_to_string(list_slice(w, p, p + size - 1), ' ') AS phrase FROM (SELECT *, unnest(range(1, k - size + 2)) AS p FROM s)),
x AS (SELECT lang, phrase, max(longer) AS longer FROM i GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN x USING (lang, phrase) WHERE x.longer IS NULL OR 100 * x.longer < 100 * c.a),
u AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS cut FROM d),
z AS (SELECT u.lang, u.phrase, u.a, l.a AS l, r.a AS r, n.n, ((1000::HUGEINT * u.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score, cut
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(list_slice(w, 1, cut), ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(list_slice(w, cut + 1, u.k), ' ') JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000"""


def _vector_codes_sql(rounds: int = 6) -> str:
    """The rounds written out: e<i> are the codebooks (part, entry, s), m<i> the nearest entries, 16 * distance + entry."""
    nearest = """(SELECT p.r, p.part, min(list_sum(list_transform(list_zip(p.s, e.s), lambda y: (y[1] - y[2]) * (y[1] - y[2])))::HUGEINT * 16 + e.entry) AS m
FROM p JOIN e{i} e ON e.part = p.part GROUP BY ALL)"""
    steps = []
    for i in range(rounds):
        steps.append(f"""m{i} AS MATERIALIZED {nearest.format(i=i)},
t{i} AS (SELECT part, m % 16 AS entry, place, sum(x)::HUGEINT AS x, count(*) AS n FROM (SELECT p.part, m, unnest(p.s) AS x, unnest(range(len(p.s))) AS place FROM p JOIN m{i} m ON m.r = p.r AND m.part = p.part) GROUP BY ALL),
u{i} AS (SELECT part, entry, list(((x - ((x % n) + n) % n) // n)::BIGINT ORDER BY place) AS s FROM t{i} GROUP BY ALL),
e{i + 1} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(u.s, e.s) AS s FROM e{i} e LEFT JOIN u{i} u ON u.part = e.part AND u.entry = e.entry)""")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, list_slice(c, part * len(c) // 8 + 1, (part + 1) * len(c) // 8) AS s FROM k, (SELECT unnest(range(8)) AS part)),
e0 AS (SELECT part, r - 1 AS entry, s FROM p WHERE r <= 16), {", ".join(steps)},
f AS MATERIALIZED {nearest.format(i=rounds)},
v AS (SELECT k.r, k.vec_id, k.label, string_agg(printf('%02x', (m % 16)::INTEGER), '' ORDER BY part) AS code, sum(m // 16)::BIGINT AS error FROM f JOIN k ON k.r = f.r GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v, h"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_decontamination": op3_decontamination,
        "op4_simhash": op4_simhash,
        "op5_mixing": op5_mixing,
        "op6_token_files": op6_token_files,
        "op7_license_scan": op7_license_scan,
        "op8_warc": op8_warc,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_pii": op10_pii,
        "op11_phrases": op11_phrases,
        "op12_vector_codes": op12_vector_codes,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _OP2, "op3_decontamination": _OP3, "op8_warc": _OP8, "op11_phrases": _OP11, "op12_vector_codes": _vector_codes_sql()}
