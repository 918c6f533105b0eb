"""Queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamstage.llm import dedup, licenses, media, minhash, packing, quality, secret_scan, segment, tokens, warc
from streamstage.llm.common import cut, documents, drop_folder, new_folder

#: The tokenizer file of the token queries; its place is looked up where it is used.
VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_flac_media(spark, sf_dir):
    return media.media_report(media.encode_media(documents(spark, sf_dir)))


def op2_bin_completion(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), VOCABULARY)


def op3_quality_ranking(spark, sf_dir):
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_warc_archives(spark, sf_dir):
    folder = new_folder(spark, "warc")
    read = cut(warc.read_archives(warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder=folder)))
    drop_folder(spark, folder)
    return read


def op5_exact_dedup(spark, sf_dir):
    return dedup.exact_groups(documents(spark, sf_dir))


def op6_license_scan(spark, sf_dir):
    return licenses.license_report(documents(spark, sf_dir))


def op7_token_files(spark, sf_dir):
    folder = new_folder(spark, "tokens")
    read = cut(tokens.read_token_files(tokens.write_token_files(documents(spark, sf_dir), VOCABULARY, folder=folder)))
    drop_folder(spark, folder)
    return read


def op8_secret_scan(spark, sf_dir):
    return secret_scan.secret_report(documents(spark, sf_dir))


def op9_near_dedup(spark, sf_dir):
    """Four-word shingles, as this query's contract says; the operator's default is five."""
    return minhash.near_groups(documents(spark, sf_dir), k=4)


def op10_sampled_segmentation(spark, sf_dir):
    return segment.segmentation_report(documents(spark, sf_dir), PIECES)


# The base columns of two operators whose other columns SQL can't tell, to be held against SQL.


def license_base_columns(spark, sf_dir):
    """Places are -1 here where there are none."""
    place = lambda c: F.coalesce(c, F.lit(-1).cast("long")).alias(c)
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", place("first_word"), place("last_word"), "base_labels")


def secret_base_columns(spark, sf_dir):
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_flac_media, op2_bin_completion, op3_quality_ranking, op4_warc_archives, op5_exact_dedup,
        op6_license_scan, op7_token_files, op8_secret_scan, op9_near_dedup, op10_sampled_segmentation, license_base_columns, secret_base_columns,
    )
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _places(phrase: str) -> str:
    """SQL for the places (from 1) in the words w where a phrase's words stand."""
    parts = phrase.split()
    return f"list_filter(range(1, len(w) - {len(parts) - 2}), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(parts)) + ")"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(_either(x) for x in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _hits(kind: str, rank: int, pattern: str, group: int) -> str:
    return f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, regexp_split_to_array(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS h, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d"


ORACLE_SQL = {
    "op4_warc_archives": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             t AS (SELECT *, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND top > page_id THEN top END AS refers_to
        FROM t""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "license_base_columns": f"""
        WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        hits AS (SELECT doc_id, w, {_places("cc by")} AS a, {_places("general public license")} AS b, {_places("all rights reserved")} AS c FROM words)
        SELECT doc_id, len(w) AS n_words, len(a || b || c) AS n_base, coalesce(list_min(a || b || c) - 1, -1) AS first_word, coalesce(list_max(a || b || c) - 1, -1) AS last_word,
               array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels
        FROM hits""",
    "secret_base_columns": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({_hits("assign", 0, _ASSIGN, 2)} UNION ALL {_hits("access", 1, "AKIA[A-Z0-9]{16,}", 0)} UNION ALL {_hits("hex", 2, "[0-9a-f]{24,}", 0)}),
        x AS (SELECT doc_id, rank, kind, unnest(range(1, len(h) + 1)) AS i, g, h, v FROM m WHERE len(h) > 0),
        y AS (SELECT doc_id, rank, kind, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS s, length(h[i]) AS n, length(v[i]) AS vn FROM x),
        k AS (SELECT *, s + n AS e FROM y WHERE kind <> 'assign' OR vn >= 6)
        SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '')) AS base_sha256
        FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""",
    "op9_near_dedup": f"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, chr(10))] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], chr(10))) END) AS s FROM words),
        one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN link l ON r.a = l.a)
        SELECT s.doc_id, len(s) AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s""",
}
