"""Pages with cut texts against a list-by-list account, and maths as typed for export."""

import random

from pyspark.sql import functions as F

from sylva.functions import markup as M
from sylva.operators import pages as P

KIND = "doc_id long, node_id string, type string, sort_path array<int>, depth int, content string, starts_page boolean, breaks int"


def fill(rows, height, chars, line, gap):
    """Pages as lists, filled one node at a time."""
    done, current, used = [], [], 0.0
    for _, node, kind, _, _, text, starts, breaks in rows:
        text = text or ""
        if kind == "page_break":
            done.append(current)
            done += [[] for _ in range(1, breaks if breaks and breaks > 0 else 1)]
            current, used = [], 0.0
            continue
        if starts and current:
            done.append(current)
            current, used = [], 0.0
        own = max(1, -(-len(text) // chars)) * line
        tall, left = own + gap, height - used
        if tall <= left:
            current.append((node, "", text))
            used += tall
            continue
        budget = left - max(0, tall - own)
        if kind in P.SPLITTABLE and budget >= line * 2 and tall - budget >= line * 2:
            fits = [e for e in range(len(text) + 1) if -(-e // chars) * line <= budget]
            best = fits[-1]
            space = text.rfind(" ", 0, best + 1) if 0 < best < len(text) else -1
            if space > 0 and text[:space].rstrip() and text[space:].lstrip():
                current.append((node, "~a", text[:space].rstrip()))
                done.append(current)
                current, used = [(node, "~b", text[space:].lstrip())], min(tall - budget, height)
                continue
        if current:
            done.append(current)
        current, used = [(node, "", text)], tall
        if tall >= height:
            done.append(current)
            current, used = [], 0.0
    return [*done, current] if current else done


def test_pages(spark):
    rng = random.Random(6)
    docs = {}
    for d in range(60):
        rows = []
        for k in range(rng.randrange(0, 30)):
            kind = rng.choice(["body", "body", "paragraph", "heading", "table", "caption", "page_break"])
            text = " ".join("w" * rng.randrange(1, 12) for _ in range(rng.choice([1, 5, 30, 80, 300]))) if kind != "page_break" else ""
            if rng.random() < 0.1:
                text = rng.choice(["x" * 900, "", None, "   "])
            rows.append((d, f"{d}.{k}", kind, [k], 1, text, rng.random() < 0.1, rng.choice([None, 1, 3])))
        docs[d] = rows
    long = [(99, f"99.{k}", "body", [k], 1, "some words of a text that goes on " * 9, False, None) for k in range(4000)]
    docs[99] = long
    table = spark.createDataFrame([r for rows in docs.values() for r in rows] + [(5, "5.x", "table_cell", [1, 1], 2, "below", False, None)], KIND).repartition(3)
    for height, chars, line, gap in ((200.0, 40, 10.0, 5.0), (700.0, 80, 14.0, 14.0)):
        got = {}
        for r in P.fill(table, height, chars, line, gap).collect():
            got.setdefault(r.doc_id, set()).add((r.node_id, r.part, r.page, r.text))
        want = {d: {(n, p, k, t) for k, page in enumerate(fill(rows, height, chars, line, gap), 1) for n, p, t in page} for d, rows in docs.items()}
        assert got == {d: w for d, w in want.items() if w}
        assert any(p == "~a" for w in got.values() for _, p, *_ in w)
    assert P.fill(table.limit(0)).count() == 0 and P.fill(table.drop("starts_page", "breaks")).count() > 0


def test_typed_maths(spark):
    cases = {
        None: None, "": [], "plain": [("text", "plain")], "a $x^2$ b": [("text", "a "), ("maths", "x^2"), ("text", " b")], "$$\\frac{a}{b}$$": [("maths", "\\frac{a}{b}")], "$x_{i$ and $y$": [("text", "$x_{i$"), ("text", " and "), ("maths", "y")],
        "cost $5 and\n$6": [("text", "cost $5 and\n$6")], "$a^$": [("text", "$a^$")], "$\\frac{a}$": [("text", "$\\frac{a}$")], "$\\frac ab$": [("maths", "\\frac ab")], "$x^^2$": [("text", "$x^^2$")], "$}{$": [("text", "$}{$")],
        "$$a\nb$$ c": [("maths", "a\nb"), ("text", " c")], "$\\sqrt{\\frac{1}{x_{i}^{2}}} \\{$": [("maths", "\\sqrt{\\frac{1}{x_{i}^{2}}} \\{")], "${x^}$": [("text", "${x^}$")], "$x_\\alpha^{y}$": [("maths", "x_\\alpha^{y}")],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i long, t string").select("t", M.typed_maths(F.col("t")).alias("p")).collect()
    assert {r.t: None if r.p is None else [tuple(x) for x in r.p] for r in rows} == cases
