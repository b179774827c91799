"""Files to findings: fixtures of our own, cache, scope, baseline, sinks, command line, streaming."""

import json

import pytest

from echofold import cli
from echofold.functions.wordpiece import WordPiece, encode_udf
from echofold.plans import analyze as plan
from echofold.plans import config as cfg
from echofold.plans import detect, queries
from echofold.sources import files, sinks
from echofold.streaming import ingest

BODY = """    var sum = 0
    var product = 1.5
    for item in items {
        if item > 12.5 {
            sum += item * 3
        } else {
            product *= item + 4.25
        }
    }
    let both = sum + product * 3
    print("done \\(both)")
    return both - 4.25
}
"""
RENAMED = BODY.replace("sum", "count").replace("item", "entry").replace("12.5", "99.0").replace("4.25", "7.5").replace("both", "merged")


def func(name, body=BODY):
    return f"func {name}(items: [Double]) -> Double {{\n{body}"


def report(spark, **sources):
    table = spark.createDataFrame([(p, s, p, None) for p, s in sources.items()], files.FILES)
    return plan.analyze(spark, files=table)


def told(r):
    return [(x["path"], x["line"], x["rule"]) for x in sinks.rows(r.findings)]


def test_exact_across_files(spark):
    r = report(spark, A="import F\n" + func("f"), B="// a comment\n" + func("g"))
    assert told(r) == [("A", 2, "exact-clone")] or told(r) == [("A", 3, "exact-clone")]
    assert "B:" in sinks.rows(r.findings)[0]["note"]


def test_near_in_one_file(spark):
    r = report(spark, A=func("f") + "\n" + func("g", RENAMED.replace("items", "entries")).replace("items", "entries"))
    assert told(r) == [("A", 1, "near-clone")]


def test_clean_and_odd_sources(spark):
    periodic = "struct T {\n" + "".join(f"    let a{i} = {i}\n" for i in range(20)) + "}\n"
    assert told(report(spark, A=periodic, B="", C="\"unclosed", D="func tiny() { 1 }\n", E="}}}")) == []


def test_located_files_have_no_exact_or_near(spark):
    r = report(spark, A="#sourceLocation(file: \"x\", line: 1)\n" + func("f"), B=func("g"))
    assert all(rule == "structural-clone" for *_, rule in told(r))


def test_edits_give_structural(spark):
    lines = [f"    total{i % 3} += values[{i}] * weights{i}.scale" for i in range(24)]
    other = [x.replace("+=", "-=") if i % 12 == 5 else x for i, x in enumerate(lines)]
    wrap = lambda name, body: f"func {name}() {{\n" + "\n".join(body) + "\n}\n"
    table = spark.createDataFrame([(p, s, p, None) for p, s in (("A", wrap("a", lines)), ("B", wrap("b", other)))], files.FILES)
    r = plan.analyze(spark, files=table, configuration=cfg.Configuration(enabled={"exact-clone": False, "near-clone": False}))
    x = sinks.rows(r.findings)
    assert x and {y["rule"] for y in x} == {"structural-clone"} and "B" in {q["path"] for y in x for q in y["related"]}


@pytest.mark.parametrize("algorithm", ["rolling", "minhash"])
def test_other_algorithms(spark, algorithm):
    units = plan.token_table(spark, spark.createDataFrame([("A", func("f")), ("B", func("g"))], "path string, source string"))
    m = detect.detect(units, detect.Settings(tokens=40, algorithm=algorithm, types=("exact", "near"))).collect()
    assert {r["type"] for r in m} == ({"exact", "near"} if algorithm == "rolling" else {"exact", "structural"})
    assert {r["file"] for r in m} == {"A", "B"}


def test_semantic_pass(spark):
    how = plan.Semantic()
    two = spark.createDataFrame([("A", func("f"), "a", None), ("B", func("f"), "b", None)], files.FILES)
    off = cfg.Configuration(enabled={"exact-clone": False, "near-clone": False, "structural-clone": False})
    r = plan.analyze(spark, files=two, configuration=off, how=how)
    assert told(r) == [("A", 1, "semantic-clone")] and "2 snippets" in r.note
    assert "no provider" in plan.analyze(spark, files=two, configuration=off, how=plan.Semantic("none")).note


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "sub").mkdir()
    (tmp_path / ".build").mkdir()
    (tmp_path / "A.swift").write_text(func("f"))
    (tmp_path / "sub/B.swift").write_text(func("g"))
    (tmp_path / ".build/C.swift").write_text(func("h"))
    (tmp_path / "notes.txt").write_text("no code")
    return tmp_path


def test_discovery_and_reading(spark, corpus):
    names = files.discover([str(corpus)])
    assert [n.removeprefix(str(corpus)) for n in names] == ["/A.swift", "/sub/B.swift"]
    assert files.discover([str(corpus)], excluded=lambda p: "sub" in p) == [f"{corpus}/A.swift"]
    assert files.canonicalized([f"{corpus}/sub/../A.swift", f"{corpus}/A.swift"]) == [f"{corpus}/A.swift"]
    (corpus / "bad.swift").write_bytes(b"let a = \xff\n")
    got = {r["path"]: r for r in files.read_files(spark, [*names, f"{corpus}/bad.swift", f"{corpus}/none.swift"], 500).collect()}
    assert got[f"{corpus}/bad.swift"]["source"] == "let a = �\n" and got[f"{corpus}/none.swift"]["detail"]
    small = {r["path"]: r["detail"] for r in files.read_files(spark, names, 10).collect()}
    assert all("10 bytes" in d for d in small.values())
    scanned = files.scan(spark, str(corpus)).select("path", "fingerprint").collect()
    assert {r["path"]: r["fingerprint"] for r in scanned if "bad" not in r["path"]} == {n: got[n]["fingerprint"] for n in names}


def test_command_line(spark, corpus, capsys):
    cache, base = str(corpus / "facts"), str(corpus / "base.json")
    run = lambda *a: cli.main(["analyze", str(corpus), "--cache", cache, *a], spark)
    assert run("--strict", "--relative-to", str(corpus)) == 1
    out = capsys.readouterr()
    assert out.out.startswith("A.swift:2:") or out.out.startswith("A.swift:1:")
    assert "sub/B.swift" in out.out and "1 finding(s)" in out.err
    assert run("--write-baseline", base) == 0
    assert run("--strict", "--baseline", base, "--format", "json") == 0
    body = json.loads(capsys.readouterr().out)
    assert (body["cacheHits"], body["cacheMisses"], body["findings"]) == (2, 0, [])
    assert run("--strict", "--only", str(corpus / "other.swift"), "--format", "sarif") == 0
    (corpus / "A.swift").write_text("// @ef:disable -- generated\n" + func("f"))
    assert run("--strict", "--format", "json") == 0
    body = json.loads(capsys.readouterr().out.partition("\n{")[2].join(["{", ""]))
    assert (body["cacheHits"], body["cacheMisses"]) == (1, 1) and body["suppressed"][0]["reason"] == "generated"
    (corpus / "conf.json").write_text('{"rules": {"exact-clone": {"severity": "error"}}, "exclude": ["sub"]}')
    assert run("--config", str(corpus / "conf.json")) == 0
    (corpus / "conf.json").write_text('{"rules": {"no-such": {}}}')
    assert run("--config", str(corpus / "conf.json")) == 78
    assert run("--write-baseline", base, "--only", "x") == 64
    assert cli.main(["analyze", str(corpus / "absent.swift"), "--no-cache"], spark) == 70
    assert cli.main(["rules"]) == 0 and cli.main(["rules", "none"]) == 64 and cli.main(["frob"]) == 64


def test_fingerprints_move_with_the_repository(spark, tmp_path):
    seen = []
    for name in ("one", "two"):
        root = tmp_path / name
        (root / ".git").mkdir(parents=True)
        (root / "A.swift").write_text(func("f"))
        (root / "B.swift").write_text(func("g"))
        seen.append([r["fingerprint"] for r in plan.analyze(spark, files.discover([str(root)])).findings.collect()])
    assert seen[0] == seen[1] and seen[0]


def test_damaged_cache_and_cancelling(spark, corpus):
    (corpus / "facts").write_text("not a table")
    r = plan.analyze(spark, files.discover([str(corpus)]), cache=str(corpus / "facts"))
    assert (r.hits, r.misses) == (0, 2) and len(told(r)) == 1
    r = plan.analyze(spark, files.discover([str(corpus)]), cache=str(corpus / "facts"), cancelled=lambda: True)
    assert r.cancelled and told(r) == [] and r.hits == 2


def test_sarif(spark):
    r = report(spark, A=func("f"), B=func("g"))
    log = json.loads(sinks.as_sarif(r))
    one = log["runs"][0]["results"][0]
    assert log["version"] == "2.1.0" and one["ruleId"] == "exact-clone" and one["relatedLocations"] and one["partialFingerprints"]
    assert len(log["runs"][0]["tool"]["driver"]["rules"]) == 4


def test_configuration(tmp_path):
    c = cfg.Configuration.of({"exclude": ["gen"]})
    assert c.is_excluded("/x/gen/y") and c.settings().types == ("exact", "near", "structural")
    assert cfg.Configuration.of({}) == cfg.Configuration()
    assert cfg.Configuration.of({"rules": {"near-clone": {"enabled": False}}}).settings().types == ("exact", "structural")
    for bad in ({"duplication": {"minimumTokens": 0}}, {"duplication": {"minimumSimilarity": 1.5}}, {"rules": {"x": {}}}, []):
        with pytest.raises(cfg.ConfigurationInvalid):
            cfg.Configuration.of(bad)
    assert cfg.scope_entries(' a.swift \r\n\n"b \\"c\\".swift"\n') == ["a.swift", 'b "c".swift']
    cfg.write_baseline(str(tmp_path / "b"), ["z", "a", "z"])
    assert cfg.load_baseline(str(tmp_path / "b")) == ["a", "z"]
    (tmp_path / "b").write_text('{"version": 2, "fingerprints": []}')
    with pytest.raises(cfg.ConfigurationInvalid):
        cfg.load_baseline(str(tmp_path / "b"))


def test_wordpiece(spark):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *"abcdefghij.,!", *["##" + c for c in "abcdefghij"], "ab", "##cd", "abc", "##def", "中", "$"]
    vocabulary = {p: i for i, p in enumerate(pieces)}
    own = WordPiece(vocabulary)
    t = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer, t.pre_tokenizer = normalizers.BertNormalizer(lowercase=True), pre_tokenizers.BertPreTokenizer()
    texts = ["abc abcdef, ÁB!", "zzz a\tb\n中c", "", "a" * 101, "a.b$c\x00​d", "abcd́e  fgh"]
    for x in texts:
        assert own.encode(x) == [2, *t.encode(x).ids, 3]
    assert own.encode("a[MASK]b") == [2, vocabulary["a"], 4, vocabulary["b"], 3]
    got = spark.createDataFrame([(x,) for x in [*texts, None]], "t string").coalesce(1).select(encode_udf(own, 4)("t")).collect()
    assert got[0][0][-1] == 3 and len(got[0][0]) == 4 and got[-1][0] is None
    with pytest.raises(ValueError):
        WordPiece({"a": 0})


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    where = [str(tmp_path / x) for x in ("in", "corpus", "out", "state")]
    (src / "A.swift").write_text(func("f"))
    ingest.watch(spark, *where).awaitTermination()
    assert spark.read.parquet(f"{where[2]}/0").count() == 0
    (src / "B.swift").write_text(func("g"))
    ingest.watch(spark, *where).awaitTermination()
    assert [r["rule"] for r in spark.read.parquet(f"{where[2]}/1").collect()] == ["exact-clone"]


def test_queries_have_names_and_sql():
    assert set(queries.SQL) <= set(queries.QUERIES)
