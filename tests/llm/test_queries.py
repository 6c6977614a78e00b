"""Every corpus query on the smallest tables, against its SQL where it has one."""

import duckdb
import pytest

from roomloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "embeddings")


def plain(v):
    return v if v is None or isinstance(v, (bool, str)) else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


#: name -> (the columns a contract asks for, the table whose rows it has one for each of, or None)
CONTRACTS = {
    "op2_decontamination": ("doc_id item_id score question_overlap answer_overlap", None),
    "op3_packing": ("doc_id start length ids_crc32 doc_tokens sequence_id offset", None),
    "op6_token_file": ("doc_id start n_tokens ids_crc32", "documents"),
    "op7_sharding": ("doc_id size text_crc32 law shard slot grown_shard", "documents"),
    "op8_pii": ("doc_id n_email n_ip n_card n_phone base_sha256 spans", "documents"),
    "op11_whitening": ("vec_id component n deviation whitened explained identity_error", None),
    "op12_toxicity": ("doc_id held_out score predicted matches", "documents"),
    "op10_suffix_dedup": ("doc_id n_bytes n_removed n_spans kept_sha256", "documents"),
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_query_has_its_columns_and_rows(spark, name):
    columns, table = CONTRACTS[name]
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == columns.split()
    rows = df.collect()
    if table:
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in queries.table(spark, SF, table).select("doc_id").collect())
    elif name == "op3_packing":
        pieces = {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        assert all(sum(n for _, n, _ in own) == own[0][2] for own in pieces.values())


def test_every_query_is_known():
    assert {*queries.ORACLE_SQL, *CONTRACTS} == set(queries.QUERIES)
