import base64

from veilworks.__main__ import main
from veilworks.plans.evaluate import EXIT_EMPTY, EXIT_LEAK, EXIT_OK, EXIT_USAGE, evaluate
from veilworks.sources import corpora


def corpus(spark, *rows):
    docs = []
    for i, (text, *entities) in enumerate(rows):
        docs.append((f"d{i}", "synthetic", "najem", text, [(kind, text.index(value), text.index(value) + len(value), value) for kind, value in entities]))
    return spark.createDataFrame(docs, corpora.GOLD)


def test_evaluation(spark, tmp_path):
    docs = corpus(
        spark,
        ("PESEL 44051401359, mail jan@poczta.pl", ("PESEL", "44051401359"), ("EMAIL_ADDRESS", "jan@poczta.pl")),
        ("Umowa z dnia 12.01.2024 i NIP 123-456-32-18.", ("DATE_TIME", "12.01.2024"), ("NIP", "123-456-32-18")),
        ("bez danych",),
    )
    run = evaluate(docs, bytes(32))
    micro = run.detection["exact"].filter("type = '__micro__'").first()
    assert (micro.tp, micro.fp, micro.fn, micro.f1) == (4, 0, 0, 1.0)
    assert run.exit_code() == EXIT_OK and run.errors.count() == 0
    assert {(r.outcome, r.in_place) for r in run.restoration.collect()} == {("exact", True)} and run.exact_rate.first().rate == 1.0
    assert all(r.leak_free and r.reconstructed for r in run.answers.collect())
    run.write(str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/detection-exact"), header=True).count() == 12
    assert spark.read.json(str(tmp_path / "out/aggregate")).first().n_docs == 3


def test_leaks_and_empty_corpora(spark):
    leaky = corpus(spark, ("Pan Kowalski i PESEL 44051401359", ("PERSON", "Kowalski"), ("PESEL", "44051401359")))
    run = evaluate(leaky)  # without a gazetteer the name stays
    assert run.exit_code() == EXIT_LEAK and [r.original for r in run.leaks.collect()] == ["Kowalski"]
    assert [r.line for r in run.errors.collect()] == ["PERSON: Kowalski"]
    assert evaluate(corpora.read_gold(spark)).exit_code() == EXIT_EMPTY


def test_job(spark, tmp_path, capsys):
    docs = corpus(spark, ("PESEL 44051401359", ("PESEL", "44051401359")))
    corpora.write_gold(docs, str(tmp_path / "gold"))
    (tmp_path / "key").write_text(base64.b64encode(bytes(range(32))).decode() + "\n")
    assert main([str(tmp_path / "out"), str(tmp_path / "gold"), "--key-file", str(tmp_path / "key")], spark) == EXIT_OK
    assert spark.read.json(str(tmp_path / "out/aggregate")).first().n_docs == 1 and "documents: 1" in capsys.readouterr().err
    assert main([str(tmp_path / "none"), str(tmp_path / "missing")], spark) == EXIT_EMPTY and not (tmp_path / "none").exists()
    assert main([], spark) == EXIT_USAGE and main(["a", "b", "--what"], spark) == EXIT_USAGE
