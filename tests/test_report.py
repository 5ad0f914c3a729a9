import os
import time
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import ledger, progress, report
from ledgerloom.streaming import drops

from . import vouchers


@pytest.fixture(scope="module")
def result(spark):
    return ledger.process(*vouchers.build(spark, vouchers.sample()))


def test_model(result):
    got = {(r["file"], r["section"]): (r["columns"], r["first_page"], r["last_page"]) for r in report.sections(result).collect()}
    assert got[("caja.pdf", "ccaf-cotizaciones")] == (5, 2, 2)
    c = {r["file"]: r for r in report.concepts(result).collect()}
    assert c["caja.pdf"]["fields"] == ["asigFam", "cotCcaf"] and c["afp.pdf"]["groups"] == ["Fondo de Pensiones", "Identificación del Trabajador", "Seguro Cesantía"]
    assert tuple(report.populations(result).first()) == (3, 1, 1)
    cover = {r["source"]: r["items"].split(",") for r in report.coverage(result).collect()}
    assert "renta_imp_fonasa" in cover["Fonasa"] and "AFP" not in cover
    assert report.with_value(result, "Renta_impo_SC").first()["n"] == 1


def test_fixture(spark, result, tmp_path):
    f = report.fixture(result)
    values = {r["path"]: r["value"] for r in f.collect()}
    assert values["documents.afp.pdf.state"] == "verificado" and values["control.caja.pdf.Creditos Personales.ok"] == "false"
    assert float(values["fields.afp.pdf.impAfp.total"]) == 1500010 and values["warnings.PDF duplicado"] == "1"
    assert not any("PEREZ" in str(v) for v in values.values())
    changed = f.where("path <> 'warnings.PDF duplicado'").withColumn("value", F.when(F.col("path") == "documents.afp.pdf.folio", "F-9").otherwise(F.col("value")))
    got = {r["path"]: r["kind"] for r in report.compare_fixtures(f, changed.union(f.limit(1).select(F.lit("x"), F.lit("y")))).collect()}
    assert got == {"warnings.PDF duplicado": "absent", "documents.afp.pdf.folio": "changed", "x": "new"}
    path = str(tmp_path / "frozen")
    assert report.save_fixture(f, path) == path and report.save_fixture(changed, path) == f"{path}.new"
    assert report.compare_fixtures(report.load_fixture(spark, path), f).count() == 0
    assert report.save_fixture(changed, path, update=True) == path and report.compare_fixtures(report.load_fixture(spark, path), f).count() > 0
    assert report.warning_histogram(result).count() > 5 and report.column_profile(result).count() == 108


def test_privacy_gate(spark, result):
    texts = spark.createDataFrame([(1, "nothing personal: 12.345"), (2, "RUT 9.068.054-4 of PEREZ"), (3, "ABARCA")], "text_id int, text string")
    got = {r["text_id"]: (r["ids"], r["names"]) for r in report.privacy_gate(result, texts).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (0, 1)}


def test_privacy_gate_knows_every_name(spark):
    names = [f"A{n:04}ABEL" for n in range(500)] + ["ZUNIGA", "YANEZ", "LIU"]
    records = [(f"d{n % 3}", n, "nombre", f"{name} X") for n, name in enumerate(names)] + [("d4", 0, "cargo", "NOBODY")]
    records = spark.createDataFrame(records, "doc_id string, row_no int, field string, txt string")
    people = records.where("field = 'nombre'").select((F.col("row_no") + 1).alias("line"), F.col("txt").alias("nombre"))
    texts = [(1, "of ZUNIGA, and A0001ABEL"), (2, "(YANEZ)\nxZUNIGAx YANEZ LIU NOBODY"), (3, "A0001 ABEL"), (4, None), (5, " ".join(names))]
    got = report.privacy_gate(SimpleNamespace(people=people, records=records), spark.createDataFrame(texts, "text_id int, text string")).collect()
    assert {r["text_id"]: (r["ids"], r["names"]) for r in got} == {1: (0, 2), 2: (0, 2), 3: (0, 0), 4: (0, 0), 5: (0, 502)}


def test_nothing_leaves_that_the_gate_holds_back(spark, result, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    write = lambda rows: lambda at: spark.createDataFrame([(r,) for r in rows], "text string").write.text(at)
    texts = lambda at: spark.read.text(at).select(F.col("value").alias("text"), F.monotonically_increasing_id().alias("text_id"))
    with pytest.raises(report.Leak, match="1 texts with 1 tax ids"):
        report.publish(result, write(["fine", "RUT 9.068.054-4"]), texts, target)
    assert os.listdir(tmp_path) == []
    assert report.publish(result, write(["fine", "12.345"]), texts, target) == target
    assert sorted(r["text"] for r in texts(target).collect()) == ["12.345", "fine"]
    gate = report.privacy_gate
    monkeypatch.setattr(report, "privacy_gate", lambda *_: (_ for _ in ()).throw(OSError("an executor is gone")))
    with pytest.raises(OSError, match="gone"):
        report.publish(result, write(["newer"]), texts, target)
    os.makedirs(f"{target}.staged-left")  # as of a run that was stopped between the steps
    assert sorted(r["text"] for r in texts(target).collect()) == ["12.345", "fine"]
    monkeypatch.setattr(report, "privacy_gate", gate)
    report.publish(result, write(["newer"]), texts, target)
    assert os.listdir(tmp_path) == ["out"] and [r["text"] for r in texts(target).collect()] == ["newer"]


def test_progress(spark):
    told = []
    run = ledger.process(*vouchers.build(spark, vouchers.sample())).worked_out(lambda percent, phase: told.append((percent, phase)))
    percents = [p for p, _ in told]
    assert percents == sorted(set(percents)) and percents[0] == 0 and percents[-1] == 100 and percents[-2] <= 99
    places = [[p.strip("_") for p in ledger.Ledger.PHASES].index(phase) for _, phase in told]  # a phase may add nothing to the one before
    assert places == sorted(places) and len(set(places)) > 5
    assert run.documents.count() == 5
    run.release()


def test_progress_counts_a_task_once_and_fails_silently(spark, tmp_path):
    told, seen = [], tmp_path / "seen"

    def twice(batches):
        if not seen.exists():
            seen.touch()
            raise RuntimeError("lost")
        yield from batches

    with pytest.raises(Exception, match="lost"), progress.Watch(spark, ["one", "two"], lambda *x: told.append(x), every=0.01) as watch:
        watch.phase()
        spark.range(10, numPartitions=1).mapInArrow(twice, "id long").count()
    assert told and all(p < 50 for p, _ in told)
    with progress.Watch(spark, ["one", "two"], lambda *x: told.append(x), every=0.01) as watch:
        watch.phase()
        spark.range(10).repartition(3).count()
        time.sleep(0.1)
        assert watch.share(watch.group) == 1.0
    assert told[-1] == (100, "two")


def test_configuration_from_tables(spark):
    from ledgerloom.operators import config as C
    from ledgerloom.plans import ledger_queries

    own = ledger_queries.own_institution(spark)
    assert "gremio" in own.profiles and "gremio" not in C.PROFILES and C.labels().keys() == C.BASE.sections.keys()
    with C.using(own):
        assert "gremio" in C.PROFILES and C.labels()["gremio-detalle"]["fondo de pensiones remuneracion imponible"] == "impCcaf"
    assert C.PROFILES is C.BASE.profiles
    none = {n: spark.createDataFrame([], s) for n, s in (("profiles", "profile string, shown string, regime string, health_code int, unbacked array<string>"), ("sections", "section string, profile string, title string, anchors array<string>, additive array<string>"), ("labels", "section string, heading string, field string"), ("totals", "ord int, profile string, key string, kind string, plus array<string>, minus array<string>, only string, why string, prefix boolean"))}
    assert C.BASE.with_tables(**none, rules=spark.createDataFrame([], "ord int, profile string, scope string, weight int, pattern string")) == C.BASE
    bad = spark.createDataFrame([(1, "nobody", "page", 1, "(")], "ord int, profile string, scope string, weight int, pattern string")
    with pytest.raises(ValueError, match="unknown profile: nobody.*unknown scope: page.*no pattern"):
        C.BASE.with_tables(**none, rules=bad)
    wrong = none | {"labels": spark.createDataFrame([("common", "Not Normal", "noField")], "section string, heading string, field string")}
    with pytest.raises(ValueError, match="isn't normal: Not Normal.*unknown field: noField"):
        C.BASE.with_tables(**wrong, rules=bad.limit(0))


def test_archives_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/a.zip", "w") as z:
        z.writestr("v.pdf", "x")
        z.writestr("__MACOSX/v.pdf", "x")
    stream = drops.arriving_entries(spark, str(tmp_path / "in"))
    seen = []
    q = drops.each_batch(stream, lambda df, n: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    with zipfile.ZipFile(tmp_path / "in/b.zip", "w") as z:
        z.writestr("w.PDF", "y")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["v.pdf", "w.PDF"]


def test_running_sums_as_a_stream(spark, tmp_path):
    rows = [("p1", "impAfp", 10, "2026-07-01 00:00:00"), ("p1", "impAfp", 5, "2026-07-02 00:00:00"), ("p2", "dias", 30, "2026-07-02 00:00:00")]
    df = spark.createDataFrame(rows, "person string, field string, value int, at string").selectExpr("person", "field", "cast(value as decimal(20,6)) value", "cast(at as timestamp) at")
    df.write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema(drops.LINES).parquet(str(tmp_path / "lines"))
    q = drops.running_sums(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["person"], r["field"], int(r["total"]), r["n"]) for r in spark.table("running").collect()] == [("p1", "impAfp", 15, 2)]
    assert drops.monthly_sums(df).agg(F.sum("total")).first()[0] == 45
