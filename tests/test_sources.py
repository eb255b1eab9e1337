"""Readers on real files, and the writers."""

from __future__ import annotations

from pathlib import Path

import pytest
from conftest import rows

from cladefreq import presets
from cladefreq.operators import detections, entities
from cladefreq.operators.joins import first_per_key
from cladefreq.plans import text_views
from cladefreq.plans.catalog import Star, text_arrays, text_columns, text_evidence
from cladefreq.sources import writers
from cladefreq.sources import (
    fingerprint,
    header_names,
    publish,
    published,
    read_arrays,
    read_class_lookup,
    read_entities,
    read_evidence,
    read_feature_lookup,
    read_published,
    read_text_table,
    shared_folder,
    write_lines,
    written,
)
from cladefreq.sources.readers import ORDER_COLUMNS


def test_blank_stays_and_na_is_missing(spark, tmp_path):
    path = tmp_path / "entities.txt"
    path.write_text(
        "accession_genbank\tclassification\tdatabase\n"
        "e1\td__Bacteria;p__P_A;c__;o__;f__;g__;s__\t\n"
        "e2\tNA\tdb\n"
        "e1\td__Bacteria;p__Q;c__;o__;f__F;g__;s__\tdb\n"
    )
    raw = read_entities(spark, str(path))
    assert rows(raw, "entity_id", "database") == [("e1", ""), ("e1", "db"), ("e2", "db")]
    assert rows(entities.clean_entities(raw, ORDER_COLUMNS), "entity_id", "group", "subgroup") == [
        ("e1", "P", "")
    ]


def test_file_order_holds_over_splits_and_files(spark, tmp_path):
    for part in range(3):
        lines = [f"{i % 50},{part},{i}" for i in range(2000)]
        (tmp_path / f"part-{part}.csv").write_text("key,part,line\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        table = read_text_table(spark, str(tmp_path), sep=",", file_order=True)
        assert table.rdd.getNumPartitions() > 10
        found = first_per_key(table, ["key"], ORDER_COLUMNS)
        assert rows(found.selectExpr("int(key) AS key", "part", "int(line) AS line")) == [
            (k, "0", k) for k in range(50)
        ]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_evidence_names_and_numbers(spark, tmp_path):
    path = tmp_path / "evidence.csv"
    path.write_text(
        "AccessionID,system.number,system,protein.name,full.seq.E.value,domain.iE.value,"
        "target.coverage,hmm.coverage,gtdb\n"
        'e1,1,"retron_I,A",RT_1,1e-30,2.5E-9,0.9,0.95,x\n'
        "e1,1,retron_II,RT_1,NA,1e-9,0.9,0.95,x\n"
    )
    raw = read_evidence(spark, str(path))
    kept = detections.evidence_rows(raw)
    assert rows(kept, "entity_id", "feature_type", "locus_number", "full_seq_e_value", "protein_name") == [
        ("e1", "retron_I,A", "1", 1e-30, "RT_1")
    ]


def test_ragged_array_file(spark, tmp_path):
    header = "\t".join(presets.ARRAY_COLUMNS)
    middle = "\t".join(["1"] * 9)
    path = tmp_path / "arrays.tab"
    path.write_text(
        f"{header}\n"
        f"G_1.2 c1\tc1_1\t{middle}\tTrue\tI-F\tI-F\t0.9\n"
        f"{header}\n"
        f"G_2 c2\tc2_1\t{middle}\tTrue\tI-E\tI-E\t0.8\n"
        f"G_3 c3\tc3_1\t{middle}\tTrue\tI-E\tI-E\t0.5\n"
    )
    found = detections.array_detections(read_arrays(spark, str(path)))
    assert rows(found) == [
        ("G_1", "c1", "c1_1", "I-F", "I-F", 0.9),
        ("G_2", "c2", "c2_1", "I-E", "I-E", 0.8),
    ]


def test_lookups_with_carriage_returns(spark, tmp_path):
    classes = tmp_path / "classes.txt"
    classes.write_bytes(b"Prediction\tSubtype\ttype\tclass\r\nI-F\tI-F\tType I\tClass 1\r\n")
    assert rows(read_class_lookup(spark, str(classes)), "prediction", "type_class") == [("I-F", "Class 1")]
    features = tmp_path / "features.txt"
    features.write_bytes(b"a\tb\r\nt1\tRM\r\n")
    assert rows(read_feature_lookup(spark, str(features))) == [("t1", "RM")]


ODD_TEXTS = ['plain', '', None, 'a,b', 'with "quotes"', ' spaces ', '#N/A', 'é;|\t', "it's"]


def test_publish_round_trip(spark, tmp_path):
    one = spark.createDataFrame(
        [(t, i, i / 3) for i, t in enumerate(ODD_TEXTS)] + [("n", None, None)], "k string, n int, x double"
    )
    two = one.where("n = 2")
    root = str(tmp_path / "out")
    for _ in range(2):  # a new release replaces what readers see
        publish({"one": one, "two": two}, root, fmt={"one": "csv"})
    listed = {r["table_name"]: r for r in published(spark, root).collect()}
    assert {(n, r["file_format"], r["n_rows"], r["release"]) for n, r in listed.items()} == {
        ("one", "csv", 10, 2),
        ("two", "parquet", 1, 2),
    }
    for name, df in (("one", one), ("two", two)):
        back = read_published(spark, root, name)
        assert back.schema.simpleString() == df.schema.simpleString()
        assert rows(back) == rows(df)
        assert listed[name]["checksum"] == fingerprint(df).first()["checksum"]


def test_checksum_tells_rows_apart_and_not_their_order(spark):
    one = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, x double")
    marks = [fingerprint(df).first()["checksum"] for df in (one, one.orderBy("x"), one.where("x = 1.5"), one.union(one))]
    assert marks[0] == marks[1] and len({*marks}) == 3
    assert tuple(fingerprint(one.where("false")).first()) == (0, 0)


def test_a_release_may_be_made_from_the_one_before(spark, tmp_path):
    root = str(tmp_path / "out")
    publish({"t": spark.range(3).withColumnRenamed("id", "n")}, root)
    publish({"t": read_published(spark, root, "t").selectExpr("n + 10 AS n")}, root)
    assert rows(read_published(spark, root, "t")) == [(10,), (11,), (12,)]


def test_a_release_that_broke_off_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "out")
    good = spark.range(3).withColumnRenamed("id", "n")
    with pytest.raises(ValueError):
        published(spark, root)
    publish({"a": good, "b": good}, root)
    bad = good.selectExpr("CAST(raise_error('broken') AS BIGINT) AS n")
    with pytest.raises(Exception, match="broken"):
        publish({"a": good.where("n = 0"), "b": bad}, root)
    assert read_published(spark, root, "a").count() == 3
    with pytest.raises(ValueError):
        read_published(spark, root, "c")


def test_lines_are_written_and_read_in_order(spark, tmp_path):
    path = str(tmp_path / "lines.txt")
    data = spark.createDataFrame([(i, None if i % 5 == 0 else f"v{i}", "") for i in range(40)], "i int, v string, blank string")
    write_lines(data.repartition(7), ["i"], path, columns=["i", "v", "blank"], header=["a.b", "v", "w"], files=3)
    files = sorted((tmp_path / "lines.txt").glob("part-*"))
    assert len(files) == 3
    for f in files:
        assert f.read_bytes().startswith(b"a.b\tv\tw\r\n") and f.read_bytes().endswith(b"\r\n")
    assert header_names(spark, path) == ["a.b", "v", "w"]
    read = read_text_table(spark, path, columns=["i", "v", "w"], file_order=True, na="NA").orderBy(*ORDER_COLUMNS)
    assert [(int(r["i"]), r["v"], r["w"]) for r in read.collect()] == [
        (i, None if i % 5 == 0 else f"v{i}", "") for i in range(40)
    ]


def test_files_grow_in_number_not_in_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE_LINES", 500, raising=False)
    path, data = tmp_path / "lines.txt", spark.range(4000).withColumnRenamed("id", "i")
    write_lines(data.repartition(7), ["i"], str(path), columns=["i"], files=3)
    lengths = [len(f.read_bytes().splitlines()) - 1 for f in sorted(path.glob("part-*"))]
    assert len(lengths) == 8 and sum(lengths) == 4000 and max(lengths) <= 1000
    read = read_text_table(spark, str(path), file_order=True).orderBy(*ORDER_COLUMNS)
    assert [int(r["i"]) for r in read.collect()] == list(range(4000))
    write_lines(data.limit(0), ["i"], str(tmp_path / "none.txt"), columns=["i"])
    assert read_text_table(spark, str(tmp_path / "none.txt"), columns=["i"]).count() == 0


def test_the_array_file_is_written_in_many_tasks(spark, tmp_path, monkeypatch):
    events = spark.range(1, 4001).selectExpr(
        "id AS event_id", "id % 90 AS user_id", "'view' AS event_type", "concat('n', id % 100) AS props"
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    few = rows(text_arrays(Star(spark, str(tmp_path))))
    monkeypatch.setattr(writers, "FILE_LINES", 500, raising=False)
    path = text_views.array_file(spark, str(tmp_path))
    assert len([*Path(path.removeprefix("file:")).glob("part-*")]) == 9  # one header line stands among the 4,000 rows
    assert rows(text_arrays(Star(spark, str(tmp_path)))) == few and len(few) == 24 * 40


def small_star(spark, folder):
    """Tables behind the evidence and entity files: 2,000 line items of 500 orders by 50 customers."""
    tables = {
        "region": "int(0) AS r_regionkey, 'ASIA' AS r_name",
        "nation": "int(0) AS n_nationkey, 'CHINA' AS n_name, int(0) AS n_regionkey",
        "customer": "id AS c_custkey, concat('n', id) AS c_name, int(0) AS c_nationkey, double(id) AS c_acctbal, 'X' AS c_mktsegment",
        "part": "id AS p_partkey, concat('red ', id) AS p_name, 'B' AS p_brand, 'T' AS p_type, int(id) AS p_size",
        "orders": "id AS o_orderkey, id % 50 AS o_custkey",
        "lineitem": "id % 500 AS l_orderkey, id % 40 AS l_partkey, id % 30 AS l_suppkey, int(id % 4) AS l_linenumber, "
        "double(id % 50) AS l_quantity, double(id) AS l_extendedprice, id % 5 / 100 AS l_discount, id % 4 / 100 AS l_tax",
    }
    sizes = {"region": 1, "nation": 1, "customer": 50, "part": 40, "orders": 500, "lineitem": 2000}
    for name, columns in tables.items():
        spark.sql(f"SELECT {columns} FROM range({sizes[name]})").write.parquet(f"{folder}/{name}.parquet")
    return Star(spark, str(folder))


@pytest.mark.parametrize("query", [text_evidence, text_columns])
def test_the_evidence_file_is_written_in_many_tasks(spark, tmp_path, monkeypatch, query):
    star = small_star(spark, tmp_path)
    few = rows(query(star))
    monkeypatch.setattr(writers, "FILE_LINES", 200, raising=False)
    written_to = []
    evidence_file = text_views.evidence_file
    monkeypatch.setattr(text_views, "evidence_file", lambda *a: written_to.append(evidence_file(*a)) or written_to[-1])
    assert few and rows(query(star)) == few
    files = [*Path(written_to[0].removeprefix("file:")).glob("part-*")]
    assert len(files) == 10 and max(len(f.read_bytes().splitlines()) for f in files) <= 401


def test_missing_cells_of_arrays(spark, tmp_path):
    path = tmp_path / "arrays.tab"
    header = "\t".join(presets.ARRAY_COLUMNS)
    path.write_bytes(f"{header}\r\nG_1 c1\tc1_1\tNA\t\r\n".encode())
    row = read_arrays(spark, str(path)).first()
    assert (row["AccessionID"], row["CRISPR"], row["Start"], row["End"]) == ("G_1 c1", None, "", "")


def test_written_table_lies_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert root is None or folder.startswith(root.rstrip("/"))
    assert folder != shared_folder(spark)
    table = spark.range(5).withColumnRenamed("id", "n")
    assert rows(written(table)) == rows(table)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_folder(Session())
