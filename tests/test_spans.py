"""Spans of tracked changes against a stack."""

import random
from collections import defaultdict

from sparkfolio.operators import spans

SCHEMA = "doc int, pos int, kind string, mark string, by string, text string, format string"


def nested(tokens):
    """A tree of lists [mark, by, children] and leaves (kind, text, format), by a stack."""
    root, stack, extra = [], [], defaultdict(int)
    top = lambda: stack[-1][2] if stack else root
    for kind, mark, by, text, form in tokens:
        names = [s[0] for s in stack]
        if kind == "open" and mark in names:
            extra[mark] += 1
        elif kind == "open":
            stack.append([mark, by, []])
        elif kind == "close" and extra[mark]:
            extra[mark] -= 1
        elif kind == "close" and mark in names:
            at = names.index(mark)
            again = [[m, b, []] for m, b, _ in stack[at + 1 :]]
            while len(stack) > at:
                done = stack.pop()
                top().append(done)
            stack += again
        elif kind != "close":
            top().append((kind, text or "", form))
    while stack:
        done = stack.pop()
        top().append(done)
    return root


def content(node):
    return node[0] != "comment" if isinstance(node, tuple) else any(map(content, node[2]))


def taken(nodes, out):
    kept = []
    for n in nodes:
        if isinstance(n, tuple):
            (out if n[0] == "comment" else kept).append(n)
        else:
            kept.append([n[0], n[1], taken(n[2], out)])
    return kept


def tidied(nodes):
    out = []
    for n in nodes:
        if isinstance(n, tuple):
            out.append(n)
            continue
        mark, by, inner = n
        comments = []
        if mark == "highlight" and content(n):
            inner = taken(inner, comments)
        if not content(n):
            taken(inner, out)
        elif out and isinstance(out[-1], list) and out[-1][:2] == [mark, by]:
            out[-1][2].extend(inner)
        else:
            out.append([mark, by, list(inner)])
        out += comments
    final = []
    for n in out:
        n = n if isinstance(n, tuple) else [n[0], n[1], tidied(n[2])]
        if final and isinstance(n, tuple) and isinstance(final[-1], tuple) and n[0] == final[-1][0] == "text" and n[2] == final[-1][2]:
            final[-1] = ("text", final[-1][1] + n[1], n[2])
        else:
            final.append(n)
    return final


def written(nodes):
    out = ""
    for n in nodes:
        if isinstance(n, tuple):
            out += "{>>" + n[1] + "<<}" if n[0] == "comment" else n[1]
        else:
            a, z = spans.DELIMITERS[n[0]]
            out += a + written(n[2]) + z
    return out


def leaves(nodes, path=()):
    for n in nodes:
        if isinstance(n, tuple):
            yield path, n[0], n[1]
        else:
            yield from leaves(n[2], (*path, (n[0], n[1])))


def test_spans_against_a_stack(spark):
    rng = random.Random(8)
    docs = {}
    for d in range(250):
        docs[d] = []
        for _ in range(rng.randrange(1, 30)):
            kind = rng.choice(["open", "open", "close", "close", "text", "text", "text", "comment", "raw"])
            mark = rng.choice(spans.MARKS) if kind in ("open", "close") else None
            docs[d].append((kind, mark, rng.choice(["ann", "bob", None]) if kind == "open" else None, rng.choice("abcxyz") if mark is None else None, rng.choice(["", "bold"]) if kind == "text" else None))
    rows = [(d, k, *t) for d, tokens in docs.items() for k, t in enumerate(tokens)]
    found = defaultdict(list)
    runs = spans.span_runs(spark.createDataFrame(rows, SCHEMA), ["doc"])
    for r in sorted(runs.collect(), key=lambda r: (r["doc"], r["run"])):
        found[r["doc"]].append((tuple((p["mark"], p["by"]) for p in r["path"]), r["kind"], r["text"]))
    markup = {r["doc"]: r["markup"] for r in spans.rendered(runs, ["doc"]).collect()}
    for d, tokens in docs.items():
        tree = tidied(nested(tokens))
        assert found[d] == list(leaves(tree)), d
        assert markup.get(d, "") == written(tree), d


def test_crossing_and_nested_marks(spark):
    line = [("open", "insertion", "a"), ("text", "one"), ("open", "deletion", "b"), ("text", "two"), ("close", "insertion"), ("text", "three"), ("close", "deletion"), ("close", "deletion"), ("text", "four"), ("open", "highlight", None), ("text", "h"), ("comment", "note"), ("text", "i")]
    rows = [(1, k, t[0], t[1] if t[0] in ("open", "close") else None, t[2] if len(t) > 2 else None, t[1] if t[0] in ("text", "comment") else None, None) for k, t in enumerate(line)]
    runs = spans.span_runs(spark.createDataFrame(rows, SCHEMA), ["doc"])
    assert spans.rendered(runs, ["doc"]).first()["markup"] == "{++one{--two--}++}{--three--}four{==hi==}{>>note<<}"
    assert spans.rendered(spans.span_runs(spark.createDataFrame([], SCHEMA), ["doc"]), ["doc"]).collect() == []


def test_leaves_are_made_once(spark, monkeypatch):
    written, real = [], spans.cut_lineage
    monkeypatch.setattr(spans, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    rows = [(1, 1, "open", "insertion", "A", None, None), (1, 2, "text", None, None, "x", None), (1, 3, "comment", None, None, "c", None), (1, 4, "close", "insertion", None, None, None)]
    frame = spark.createDataFrame(rows, "doc int, pos int, kind string, mark string, by string, text string, format string")
    runs = spans.span_runs(frame, ["doc"])
    assert written == [["doc", "pos", "kind", "text", "format", "path"]] and "Broadcast" not in runs._jdf.queryExecution().executedPlan().toString()
    assert [(r["kind"], r["text"], [p["mark"] for p in r["path"]]) for r in runs.orderBy("run").collect()] == [("text", "x", ["insertion"]), ("comment", "c", ["insertion"])]
