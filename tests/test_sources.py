"""Formats, guards, sinks and streams."""

import json

import pytest

from tracewell.operators.ingest import canonical
from tracewell.operators.reports import checksums, text_report
from tracewell.sources import generator, readers, sinks
from tracewell.streaming import wire

CSV = "txid,timestamp,input_addresses,output_addresses,input_amounts,output_amounts,fee,src_port,extra\nt1,2026-07-01 00:00:00,a|b,c,1|2,3,0.1,8333,x\n00123,2026-07-01,d,e,1e5,2,,,\n"
RECORD = {"txid": "t1", "timestamp": "2026-07-01", "input_addresses": ["a", "b"], "output_addresses": "c", "input_amounts": [1, 2.5], "output_amounts": "3", "fee": 0.1}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    rows = readers.get_adapter(spark, str(tmp_path / "a.csv")).load(str(tmp_path / "a.csv")).orderBy("row_idx").collect()
    assert [r.txid for r in rows] == ["t1", "00123"] and rows[0].extra == "x" and rows[1].input_amounts == "1e5"


@pytest.mark.parametrize("doc", [[RECORD], RECORD, {"t1": {k: v for k, v in RECORD.items() if k != "txid"}}])
def test_json_shapes(spark, tmp_path, doc):
    p = tmp_path / "a.json"
    p.write_text(json.dumps(doc))
    rows = readers.get_adapter(spark, str(p)).load(str(p)).collect()
    assert [(r.txid, r.input_addresses, r.input_amounts, r.output_addresses) for r in rows] == [("t1", "a|b", "1|2.5", "c")]


@pytest.mark.parametrize("text", ["not json", '"text"', '{"t1": 5}', "[1, 2]"])
def test_bad_json(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError):
        readers.JsonAdapter(spark).load(str(tmp_path / "a.json"))


XML = "<transactions><transaction><txid>00123</txid><timestamp>2026-07-01</timestamp><input_addresses>%s</input_addresses><output_addresses>c</output_addresses><input_amounts>1|2</input_amounts><output_amounts>3</output_amounts></transaction></transactions>"


@pytest.mark.parametrize("cell", ["a|b", "<address>a</address><address>b</address>"])
def test_xml(spark, tmp_path, cell):
    (tmp_path / "a.xml").write_text(XML % cell)
    rows = readers.get_adapter(spark, str(tmp_path / "a.xml")).load(str(tmp_path / "a.xml")).collect()
    assert [(r.txid, r.input_addresses, r.input_amounts) for r in rows] == [("00123", "a|b", "1|2")]


@pytest.mark.parametrize("text", ["<transactions></transactions>", '<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]>' + XML % "&e;", '<!DOCTYPE x [<!ENTITY a "aa"><!ENTITY b "&a;&a;">]>' + XML % "&b;"])
def test_bad_xml(spark, tmp_path, text):
    (tmp_path / "a.xml").write_text(text)
    with pytest.raises(ValueError):
        readers.XmlAdapter(spark).load(str(tmp_path / "a.xml"))


def test_guards_and_registry(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    path = str(tmp_path / "a.csv")
    with pytest.raises(ValueError):
        readers.CsvAdapter(spark, max_mb=0.00001).load(path)
    with pytest.raises(ValueError):
        readers.CsvAdapter(spark, max_rows=1).load(path)
    readers.guard_size(spark, str(tmp_path / "missing.csv"))
    assert isinstance(readers.get_adapter(spark, chain="bitcoin"), readers.CsvAdapter)
    for bad in ({"chain": "zz"}, {"path": "x.pdf"}):
        with pytest.raises(ValueError):
            readers.get_adapter(spark, **bad)
    assert readers.whitelist(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "w.csv").write_text("indicator,type,label,severity\n x ,IP,l,\ny,other,l,1\n,ip,l,1\n")
    assert [tuple(r) for r in readers.watchlist(spark, str(tmp_path / "w.csv")).collect()] == [("x", "ip", "l", 0.5)]


def test_sinks(spark, tmp_path):
    rows = generator.transactions(spark, 40)
    sinks.write_csv(canonical(rows), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 40
    sinks.write_xml(rows, str(tmp_path / "xml"), 5)
    assert readers.XmlAdapter(spark).read(str(tmp_path / "xml")).count() == 5
    sinks.write_json(rows, str(tmp_path / "json"), 5)
    assert spark.read.json(str(tmp_path / "json")).count() == 5
    ledger, seen = sinks.split_layers(rows)
    assert ledger.count() == 40 and 40 < seen.count() <= 160
    assert checksums(spark, str(tmp_path / "json" / "*.json")).collect()[0].length > 0
    assert text_report(spark.createDataFrame([("a", 1), ("b", 2)], "name string, value int"), "T").collect()[0].text == "T\na: 1\nb: 2"


def test_streams_agree_with_batch(spark, tmp_path):
    rows = spark.range(300).selectExpr("id AS obs_id", "timestamp_ntz'2026-07-01 00:00:00' + make_dt_interval(0, 0, cast(id AS int) % 90) AS ts", "concat('10.0.0.', id % 5) AS src_ip", "'d' AS dst_ip", "8333 AS src_port", "concat('t', id % 40) AS txid", "'US' AS geo_country")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = wire.telemetry_stream(spark, str(tmp_path / "in"), rows.schema)
    got = wire.run_once(wire.first_seen(stream), "first_seen_test", str(tmp_path / "c1"), "complete")
    assert got.count() == 40 and got.agg({"ip_observation_count": "sum"}).collect()[0][0] == 300
    twice = wire.run_once(wire.deduplicated(stream), "dedup_test", str(tmp_path / "c2"), "append")
    assert twice.count() == rows.dropDuplicates(["txid", "src_ip", "dst_ip", "src_port", "ts"]).count()
    hourly = wire.run_once(wire.hourly(stream, "1 minute"), "hourly_test", str(tmp_path / "c3"), "complete")
    assert hourly.agg({"n_obs": "sum"}).collect()[0][0] == 300
