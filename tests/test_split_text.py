"""Large files in many tasks: quoted CSV against the csv module, JSON documents against the json module."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from regulon.sources import readers as RD
from regulon.sources import split_text as ST


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def tasks(df):
    """Number of splits that the pieces of a file come from."""
    return df.select("block").distinct().count()


def csv_text(rows, **options):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", **options).writerows(rows)
    return out.getvalue()


def random_fields(rng, n):
    bits = ["a", "b ", ",", '"', '""', "\n", "\n\n", "é", "x" * 30, " ", "\t", "'"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(n)]


def test_quoted_csv_in_many_splits(spark, tmp_path, small_splits):
    names, want = ["id", "prompt", "more"], {}
    for seed in range(4):
        rng = random.Random(seed)
        rows = [names] + [[f"k{i}", *random_fields(rng, 2)] for i in range(300)]
        p = tmp_path / f"{seed}.csv"
        p.write_text(csv_text(rows, quoting=csv.QUOTE_ALL if seed % 2 else csv.QUOTE_MINIMAL))
        want[p.name] = rows[1:]
    assert tasks(ST.pieces(spark, str(tmp_path / "0.csv"), "\n")) > 5
    got = {}
    for r in ST.read_csv(spark, str(tmp_path), names).orderBy("file", "offset").collect():
        name = r["file"].rsplit("/", 1)[1]
        got.setdefault(name, []).append([r["id"], r["prompt"], r["more"]])
        at = (tmp_path / name).read_bytes()[r["offset"] :]
        assert at.startswith((r["id"].encode(), f'"{r["id"]}"'.encode()))
    assert got == want


def test_a_record_over_many_splits_and_stray_quotes(spark, tmp_path, small_splits):
    long = "\n".join(f'line "{i}", of many' for i in range(900))
    rows = [["id", "prompt"], ["a", long], ["b", "plain"], ["c", 'mid"dle'], ["d", long + '"']]
    text = csv_text(rows[:3]) + 'c,mid"dle\n\n  \n' + csv_text(rows[4:]).rstrip("\n")  # quotes in an unquoted field, blank lines, no last newline
    p = tmp_path / "b.csv"
    p.write_text(text)
    got = ST.read_csv(spark, str(p), rows[0]).orderBy("offset").collect()
    assert [[r["id"], r["prompt"]] for r in got] == rows[1:]


def test_many_files_crlf_and_headers(spark, tmp_path, small_splits):
    for k in range(3):
        rows = [["id", "pert", "gene", "label"]] + [[f"{k}-{i}", f"p{i}", f"g,{i}" if i % 2 else "g", "up"] for i in range(100)]
        (tmp_path / f"{k}.csv").write_bytes(csv_text(rows).replace("\n", "\r\n").encode())
    got = RD.read_pairs(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((f"{k}-{i}", f"p{i}", f"g,{i}" if i % 2 else "g", "up") for k in range(3) for i in range(100))
    (tmp_path / "0.csv").write_text("id,gene,pert,label\nx,y,z,up\n")
    with pytest.raises(Exception, match="header does not conform"):
        RD.read_pairs(spark, str(tmp_path)).collect()


def test_last_record_wins_by_byte_offset(spark, tmp_path, small_splits):
    rows = [["prompt", "id"]] + [[f"version {k}\nof\n{'x' * (k % 40)}", str(k % 13)] for k in range(700)]
    (tmp_path / "p.csv").write_text(csv_text(rows))
    got = {r["id"]: r["prompt"] for r in RD.read_prompts(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {i: p for p, i in rows[1:]}


def test_csv_lines_are_not_shuffled(spark, tmp_path, small_splits):
    """Lines stay in the task that reads them; only parts of records cut by a split are grouped."""
    rows = [["id", "text"]] + [[f"k{i}", f'said "{i}",\nthen more'] for i in range(400)]
    (tmp_path / "a.csv").write_text(csv_text(rows))
    df = ST.csv_records(spark, str(tmp_path / "a.csv"))
    assert tasks(ST.pieces(spark, str(tmp_path / "a.csv"), "\n")) > 5
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
    assert sorted(df.select("number").toPandas()["number"]) == list(range(401))


def test_quotes_decide_as_the_rule_says(spark, tmp_path, small_splits):
    """Random lines of quotes and commas, against the rule walked character by character."""
    rng = random.Random(5)
    lines = ["".join(rng.choices('ab,,""""', k=rng.randint(1, 14))) for _ in range(700)]
    (tmp_path / "q.csv").write_text("\n".join(lines) + "\n")
    want, state = [], 0
    for line in lines:
        if state:
            want[-1] += "\n" + line
        else:
            want.append(line)
        parts = line.replace('""', "").split('"')
        for k, part in enumerate(parts[:-1]):
            state = 0 if state else int(part.endswith(",") or (k == 0 and part == ""))
    got = ST.csv_records(spark, str(tmp_path / "q.csv")).orderBy("offset").collect()
    assert [r["record"] for r in got] == want and [r["number"] for r in got] == list(range(len(want)))


def test_empty_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,pert,gene,label\n")
    (tmp_path / "n.csv").write_text("")
    assert RD.read_pairs(spark, str(tmp_path)).count() == 0


# ── JSON ─────────────────────────────────────────────────────────────────

ENTRY = "struct<a:double,t:string>"


def entries(spark, path):
    out = {}
    for r in ST.json_entries(spark, str(path), "rows", ENTRY).collect():
        out.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["key"], r["entry"]["a"], r["entry"]["t"]))
    return {k: sorted(v, key=str) for k, v in out.items()}


def wanted(doc):
    return sorted(((k, v.get("a"), v.get("t")) for k, v in doc["rows"].items()), key=str)


def random_entry(rng):
    bits = ["{", "}", "[", "]", '"', "\\", "\\\\", ",", ":", "\n", "é", 'rows": {', "plain", "}}}", " "]
    e = {"a": rng.choice([1.5, -2.0, 0.0, None]), "t": "".join(rng.choices(bits, k=rng.randint(0, 12)))}
    if rng.random() < 0.3:
        e["list"] = [{"rows": {"x": {"a": 9}}}, [1, [2]], "}"]
    if rng.random() < 0.3:
        e["rows"] = {"inner": {"a": 7}}
    return e


def test_json_documents_in_many_splits(spark, tmp_path, small_splits):
    want = {}
    for seed, options in enumerate([{}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")}]):
        rng = random.Random(seed)
        doc = {"version": 3, "meta": {"rows": 1, "x": {"a": 1.0}, "y": {"t": "no"}}, "list": [{"rows": {"z": {"a": 1}}}, {"b": [1]}, "s"],
               "rows": {f"k{i}": random_entry(rng) for i in range(400)}, "after": {"u": {"a": 2.0}}, "flat": {"a": 1}, "end": [[{"q": {}}]]}
        p = tmp_path / f"{seed}.json"
        p.write_text(json.dumps({"rows": doc["rows"]} if seed == 2 else doc, **options) + "\n" * seed)
        want[p.name] = wanted(doc)
    small = [{}, {"rows": {}}, {"x": {"a": {"a": 1}}}, {"rows": {}, "x": {"y": {"a": 1}}}, {"rows": {"a": {}}},
             {"rows": {"a": {"a": 1, "t": "}"}}, "z": [{}, {}]}, {"z": [{}], "rows": {"b": {"t": "x"}}}]
    for k, doc in enumerate(small):
        (tmp_path / f"small{k}.json").write_text(json.dumps(doc))
        want[f"small{k}.json"] = wanted({"rows": {}, **doc})
    assert tasks(ST.pieces(spark, str(tmp_path / "0.json"), "}")) > 5
    assert entries(spark, tmp_path) == {k: v for k, v in want.items() if v}


def test_broken_files_give_no_rows(spark, tmp_path, small_splits):
    rng = random.Random(8)
    good = json.dumps({"meta": {"m": {"a": 1}}, "rows": {f"k{i}": random_entry(rng) for i in range(60)}, "x": {"y": {"a": 1}}})
    end = good.rindex("}")
    bad = {
        "cut": good[: len(good) // 2], "cut_after_entry": good[: good.index('"k30"')].rstrip(", "), "open": good[:end], "twice": good + good, "tail": good + " x",
        "closed": good + "}", "quote": good.replace('"k20"', '"k20', 1), "comma": good.replace(', "k20"', ' "k20"', 1), "word": good.replace('"k20": {', '"k20": {bad ', 1),
        "array": f"[{good}]", "outside": good.replace('"m": {', '"m": {bad ', 1), "empty": "", "text": "nothing",
    }
    for name, text in bad.items():
        with pytest.raises(ValueError):
            json.loads(text) if name != "array" else json.loads("")
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "good.json").write_text(good)
    rows = ST.json_entries(spark, str(tmp_path), "rows", ENTRY).select(F.regexp_extract("file", "[^/]*$", 0).alias("f"), "key").collect()
    assert {r["f"] for r in rows} == {"good.json"} and len(rows) == 60


def test_cache_of_one_large_file(spark, tmp_path, small_splits):
    rows = {f"P{i}_G{i}": {f"{c}_seed{s}": (i + s) % 3 / 2 for c in ("prediction_up", "prediction_down") for s in (42, 43)}
            | {"reasoning_trace_seed42": f'{{"id": "{i}"}}\nthen \\ }} more'} for i in range(500)}
    p = tmp_path / "cache.json"
    p.write_text(json.dumps({"config": {"seeds": [42, 43]}, "rows": rows}, indent=1))
    got = {(r["id"], r["seed"]): r for r in RD.read_response_cache(spark, str(p)).collect()}
    assert set(got) == {(k, s) for k in rows for s in (42, 43)}
    assert all(got[k, 42]["reasoning_trace"] == v["reasoning_trace_seed42"] for k, v in rows.items())
    assert all(got[k, s]["prediction_up"] == v[f"prediction_up_seed{s}"] for k, v in rows.items() for s in (42, 43))


def test_json_text_is_not_shuffled(spark, tmp_path, small_splits):
    """Pieces stay in the task that reads them, and neighbours are parsed together."""
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"meta": {"a": {"t": "x"}}, "rows": {f"k{i}": {"a": float(i), "t": f'}} "{i}" \\'} for i in range(400)}}))
    df = ST.json_entries(spark, str(p), "rows", ENTRY)
    assert tasks(ST.pieces(spark, str(p), "}")) > 5
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
    assert sorted((r["key"], r["entry"]["a"]) for r in df.collect()) == sorted((f"k{i}", float(i)) for i in range(400))


def test_cuttings_over_small_batches_and_chunks(spark, tmp_path, small_splits, monkeypatch):
    rng = random.Random(11)
    doc = {"config": {f"c{i}": {"a": 1} for i in range(30)}, "rows": {f"k{i}": random_entry(rng) for i in range(150)}}
    for name, text in {"good": json.dumps(doc), "indented": json.dumps(doc, indent=20), "elsewhere": json.dumps(doc).replace(', "c20"', ' "c20"', 1),
                       "word": json.dumps(doc).replace('"k70": {', '"k70": 5 {', 1)}.items():
        (tmp_path / f"{name}.json").write_text(text)
    monkeypatch.setattr(ST, "CHUNK_BYTES", 300)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        got = entries(spark, tmp_path)
    finally:
        spark.conf.set(key, old)
    assert got == {"good.json": wanted(doc), "indented.json": wanted(doc)}
