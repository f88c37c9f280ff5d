"""The registered queries: against their SQL where there is one, and their contract's columns."""

import hashlib

import duckdb
import pytest

from lumenframe.llm import queries as Q
from tests.llm.common import WORD

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op2_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3_lz_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op4_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op5_token_files": "doc_id start n_tokens ids_crc32", "op6_toxicity": "doc_id held_out score predicted", "op7_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8_url_filter": "page_id host fetched blocked n_active matched_key listed_since", "op9_sentencepiece": "doc_id n_pieces ids_crc32 decoded_sha256 exact", "op10_simhash": "doc_id fingerprint component_id",
    "op11_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256", "op13_lsh_forest": "doc_id n_shingles component_id kept",
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_columns(spark, name):
    assert set(COLUMNS[name].split()) <= set(Q.QUERIES[name](spark, SF).columns)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_rows_as_sql_gives_them(spark, name):
    df = Q.QUERIES[name](spark, SF)
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = c.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


def test_substring_query_removes_what_the_plain_version_removes(spark):
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    seen, want = set(), {}
    for i, t in docs:
        w = WORD.findall(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op4_substring_dedup(spark, SF).collect()} == want
