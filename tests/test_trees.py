import json
import random

from ledgerloom.operators import trees


def plain(e, a, path=""):
    """The same comparison as a recursion over Python values."""
    kind = lambda v: "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "scalar"
    name = lambda v: "object" if v is None or isinstance(v, (list, dict)) else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
    text = lambda v: v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    if kind(e) == kind(a) == "array":
        out = [(f"{path}.length", "changed", str(len(e)), str(len(a)))] if len(e) != len(a) else []
        return out + [d for n, (x, y) in enumerate(zip(e, a)) for d in plain(x, y, f"{path}[{n}]")]
    if kind(e) == kind(a) == "object":
        out = [(f"{path}.{k}", "absent", text(v), "(ausente)") for k, v in e.items() if k not in a] + [(f"{path}.{k}", "new", None, text(v)) for k, v in a.items() if k not in e]
        return out + [d for k in e if k in a for d in plain(e[k], a[k], f"{path}.{k}")]
    if kind(e) != "scalar":
        return [(path, "changed", "(arreglo)" if kind(e) == "array" else "(objeto)", name(a))]
    return [] if name(e) == name(a) and e == a else [(path, "changed", text(e), text(a))]


def grown(rnd, depth=0):
    k = rnd.randrange(9 if depth < 4 else 6)
    if k > 6:
        return {rnd.choice(["a", "b", "a.b", "c[0]", "sha256", "ñ"]): grown(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    if k == 6:
        return [grown(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return rnd.choice([None, True, False, 1, 2.5, "", "1", 'x"y', "é{"])


def changed(rnd, v):
    if rnd.random() < 0.15:
        return grown(rnd, 2)
    if isinstance(v, dict):
        return {k: changed(rnd, x) for k, x in v.items() if rnd.random() > 0.1} | ({"d": 1} if rnd.random() < 0.1 else {})
    return [changed(rnd, x) for x in v][: 9 if rnd.random() > 0.1 else 1] if isinstance(v, list) else v


def test_nested_differences(spark):
    rnd = random.Random(6)
    rows = [(n, x := {"r": [grown(rnd), grown(rnd)], "a": {"b": grown(rnd)}}, changed(rnd, x)) for n in range(150)]
    df = spark.createDataFrame([(n if n % 9 else None, n, json.dumps(e), json.dumps(a)) for n, e, a in rows], "k long, path long, e string, a string")
    got = sorted(map(tuple, trees.nested_differences(df, ["k", "path"], "e", "a", ignored=(".r[0].sha256",)).toDF("k", "n", "path", "kind", "expected", "actual").collect()), key=str)
    want = [(n if n % 9 else None, n, *d) for n, e, a in rows for d in plain(e, a) if d[0] != ".r[0].sha256" or d[1] == "new"]
    assert got == sorted(want, key=str) and {d[3] for d in want} == {"absent", "new", "changed"}


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "{}", None), (3, None, "[]"), (4, "no json {", "no json {"), (5, "no json {", "x"), (6, "1.0", "1"), (7, '{"a": 1}', '{"a" : 1.0}'), (8, '{"sha256": 1}', '{"sha256": 2}')], "k int, e string, a string")
    assert sorted(map(tuple, trees.nested_differences(df, ["k"], "e", "a").collect())) == [(2, "", "absent", "{}", "(ausente)"), (3, "", "new", None, "[]"), (5, "", "changed", "no json {", "x")]
    assert trees.nested_differences(df.limit(0), ["k"], "e", "a").count() == 0
