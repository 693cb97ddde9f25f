"""Replay of whole logs against a plain tree that is edited action by action."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sylva.plans import structure as S
from sylva.schema import HEADINGS, NODE_TYPES, TARGETS
from sylva.sources.corpus import nodes_of_lines

STYLE = ["bold", "italic", "underline", "color", "highlight", "alignment", "font_size"]


class Node:
    def __init__(self, id, type, content, style, meta):
        self.id, self.type, self.content, self.style, self.meta, self.children = id, type, content, style, meta, []

    def walk(self):
        for c in list(self.children):
            yield c
            yield from c.walk()

    def copy(self):
        n = Node(self.id, self.type, self.content, dict(self.style), dict(self.meta))
        n.children = [c.copy() for c in self.children]
        return n


def made(doc, a, *more):
    return "n_" + hashlib.sha256("|".join(["replay", f"{doc}.{a['seq']}.{a['i']}", *more]).encode()).hexdigest()[:12]


class Failed(Exception):
    pass


def parent_of(root, id):
    return next((p for p in [root, *root.walk()] if any(c.id == id for c in p.children)), None)


def act(doc, root, a, selected):
    """Applies one action to the tree and returns what it selects."""
    by = {n.id: n for n in root.walk()}
    kind = a["type"]
    ids = a.get("node_ids")
    if ids:
        scope = [n for n in root.walk() if n.id in ids]
    elif a.get("target"):
        scope = [n for n in root.walk() if n.type in TARGETS.get(a["target"], [])]
    else:
        scope = [n for n in root.walk() if n.id in selected]
    at = lambda id: (lambda p: (p, next(k for k, c in enumerate(p.children) if c.id == id)))(parent_of(root, id))
    if kind in ("select", "copy"):
        return {n.id for n in scope}
    if kind == "highlight":
        for n in scope:
            n.style["highlight"] = a.get("color") or "#fff59d"
    elif kind == "align":
        for n in scope:
            n.style["alignment"] = a.get("alignment") or "left"
    elif kind == "format":
        for n in scope:
            n.style |= {f: a[f] for f in ("bold", "italic", "underline", "color") if a.get(f) is not None}
    elif kind == "case":
        for n in scope:
            n.content = n.content.upper()
    elif kind == "replace":
        for n in scope:
            n.content = n.content.replace(a["find"], a.get("put") or "") if a.get("find") else n.content
    elif kind == "spacing":
        for n in scope:
            n.meta |= {f: a[g] for f, g in (("line_spacing", "line"), ("space_before_pt", "before_pt"), ("space_after_pt", "after_pt")) if a.get(g) is not None}
    elif kind == "rewrite":
        hit = set()
        for id, text in (a.get("edits") or {}).items():
            if id in by and text and text.strip():
                by[id].content = text
                hit.add(id)
        return hit
    elif kind == "delete":
        for n in scope:
            p = parent_of(root, n.id)
            if p:
                p.children = [c for c in p.children if c.id != n.id]
        return set()
    elif kind == "insert":
        if (a.get("node_type") or "body") not in NODE_TYPES:
            raise Failed
        n = Node(made(doc, a), a.get("node_type") or "body", a.get("content") or "", {f: a.get(f) for f in ("bold", "italic", "underline", "color")}, {})
        after = a.get("after_id") or (ids[0] if ids else None)
        if after in by:
            p, k = at(after)
            p.children.insert(k + 1, n)
        else:
            root.children.append(n)
    elif kind == "move":
        to = root if a.get("to_id") == str(doc) else by.get(a.get("to_id"))
        tops = [n for n in scope if not any(n in m.walk() for m in scope)]
        if to is not None and not any(to is n or to in n.walk() for n in tops):
            for n in tops:
                p = parent_of(root, n.id)
                p.children.remove(n)
                to.children.append(n)
    elif kind == "merge":
        if len(scope) < 2:
            raise Failed
        scope[0].content = " ".join(n.content for n in scope).strip(" ")
        for n in scope[1:]:
            p = parent_of(root, n.id)
            if p:
                p.children.remove(n)
        return {scope[0].id}
    elif kind == "split":
        for n in scope:
            parts = [p.strip(" ") for p in n.content.split(a.get("separator") or ". ") if p.strip(" ")]
            if len(parts) < 2:
                continue
            n.content = parts[0]
            p, k = at(n.id)
            p.children[k + 1 : k + 1] = [Node(made(doc, a, n.id, str(j)), n.type, t, dict(n.style), {}) for j, t in enumerate(parts[1:], 1)]
        return None
    elif kind == "list":
        return do_list(doc, root, a, scope, at)
    elif kind == "border":
        tables = [n for n in scope if n.type == "table"] or [t for t in root.walk() if t.type == "table" and any(n in scope for n in t.walk())]
        sides = a.get("sides") or {}
        for t in tables:
            t.meta["borders"] = {s: float(sides.get(s, 0.0)) if sides else 0.5 for s in S.SIDES}
        return {t.id for t in tables}
    elif kind == "paste":
        after = a.get("after_id")
        for n in [n for n in root.walk() if n.id in selected]:
            dup = Node(made(doc, a, n.id), n.type, n.content, dict(n.style), dict(n.meta))
            if after and parent_of(root, after):
                p, k = at(after)
                p.children.insert(k + 1, dup)
                after = dup.id
            else:
                root.children.append(dup)
        return selected
    return {n.id for n in scope} if kind != "insert" else None


def enumerated(text):
    """Texts of this test only enumerate by semicolons."""
    body = text.strip()
    if body.count(";") < 2:
        return "", []
    lead, _, after = body.partition(":")
    led = bool(_) and bool(after.strip()) and body.find(":") > 0
    items = [p.strip() for p in (after if led else body).split(";") if p.strip()]
    items = [i[:1].upper() + i[1:] for i in items]
    return (lead + ":" if led else "", items) if len(items) >= 2 else ("", [])


def do_list(doc, root, a, scope, at):
    scope = [n for n in scope if n.type not in ("table", "table_row")]
    if scope and all(n.type in HEADINGS for n in scope):
        under = []
        for h in scope:
            p, k = at(h.id)
            for n in p.children[k + 1 :]:
                if n.type in HEADINGS:
                    break
                under.append(n)
        scope = under
    kind = a.get("kind") or "bullet"
    level = max(0, min(a.get("level") or 0, 8))
    if kind == "none":
        for n in scope:
            n.meta |= {"list_kind": None, "list_level": None}
        return {n.id for n in scope}
    scope = [n for n in scope if n.type in ("body", "paragraph")]
    cuts = {n.id: enumerated(n.content) for n in scope if enumerated(n.content)[1]}
    if cuts:
        scope = [n for n in scope if n.id in cuts]
    else:
        colon = lambda n: n.content.rstrip(" ").endswith(":")
        scope = [n for k, n in enumerate(scope) if not (colon(n) and any(not colon(m) for m in scope[k + 1 :]))]
    named, touched = "number" if kind == "number" else "bullet", set()
    for n in scope:
        lead, items = cuts.get(n.id, ("", []))
        touched.add(n.id)
        n.meta |= {"list_kind": named, "list_level": level}
        if items:
            if lead:
                n.content = lead
                n.meta |= {"list_kind": None, "list_level": None}
            else:
                n.content = items.pop(0)
            p, k = at(n.id)
            new = [Node(made(doc, a, n.id, str(j)), "body", t, dict(n.style), {"list_kind": named, "list_level": level}) for j, t in enumerate(items, 1)]
            p.children[k + 1 : k + 1] = new
            touched |= {x.id for x in new}
    return touched


def follow(doc, root, log):
    """The tree after all versions of the log; a version that fails leaves it as it was."""
    for seq in sorted({a["seq"] for a in log}):
        kept, selected = root.copy(), set()
        try:
            for a in sorted((a for a in log if a["seq"] == seq), key=lambda a: a["i"]):
                before = {n.id for n in root.walk()}
                got = act(doc, root, a, selected)
                selected = {n.id for n in root.walk()} - before if got is None else got
        except Failed:
            root = kept
    return root


def flat(root, path=()):
    for k, n in enumerate(root.children, 1):
        yield (*path, k), n
        yield from flat(n, (*path, k))


def tree(doc, rows):
    root = Node(str(doc), "document", "", {}, {})
    by = {(): root}
    for r in sorted(rows, key=lambda r: r.sort_path):
        style = {f: r.style[f] for f in STYLE}
        meta = {f: v for f, v in r.meta.asDict().items()} if r.meta else {}
        n = by[tuple(r.sort_path)] = Node(r.node_id, r.type, r.content, style, meta)
        by[tuple(r.sort_path[:-1])].children.append(n)
    return root


FIELDS = "doc_id long, seq long, i int, type string, target string, node_ids array<string>, color string, bold boolean, alignment string, find string, put string, node_type string, content string, after_id string, to_id string, separator string, kind string, level int, line double, after_pt double, sides map<string,double>, edits map<string,string>"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def replayed(spark, nodes, actions):
    rows = spark.createDataFrame([tuple(a.get(n) for n in NAMES) for a in actions], FIELDS)
    return S.replay(nodes, rows)


def compare(spark, docs, actions):
    nodes = nodes_of_lines(spark.createDataFrame(docs, "doc_id long, text string")).cache()
    before = {}
    for r in nodes.collect():
        before.setdefault(r.doc_id, []).append(r)
    got = {}
    for r in replayed(spark, nodes, actions).collect():
        got.setdefault(r.doc_id, {})[tuple(r.sort_path)] = r
    for doc, _ in docs:
        root = follow(doc, tree(doc, before[doc]), [a for a in actions if a["doc_id"] == doc])
        want = dict(flat(root))
        have = got.get(doc, {})
        log = [a for a in actions if a["doc_id"] == doc]
        assert [(p, n.id, n.type, n.content) for p, n in sorted(want.items())] == [(p, r.node_id, r.type, r.content) for p, r in sorted(have.items())], (doc, log)
        for p, n in want.items():
            r = have[p]
            assert r.parent_id == (want[p[:-1]].id if len(p) > 1 else str(doc)) and r.depth == len(p), (doc, p, log)
            assert {f: n.style.get(f) for f in STYLE} == {f: r.style[f] for f in STYLE}, (doc, p, log)
            meta = r.meta.asDict() if r.meta else {}
            assert {f: v for f, v in n.meta.items() if v is not None} == {f: v for f, v in meta.items() if v is not None}, (doc, p, log)


LINES = ["A heading line", "long text one. long text two. and a third one of them all, which is body", "", "x | y | z", "points: first thing; second thing; third thing which makes it long enough for body",
         "these are announced in the text that follows, as the colon at its very end says to us:", "p | q", "a mail@example.com reference that is quite long enough to be one of them", "Sub", "the last text of all the texts here is long enough for a body. And has two parts"]


def random_log(rng, doc, ids, versions):
    log = []
    for seq in range(1, versions + 1):
        for i in range(rng.choice([1, 1, 2, 3])):
            a = {"doc_id": doc, "seq": seq, "i": i, "type": rng.choice(["highlight", "format", "case", "replace", "spacing", "select", "delete", "insert", "move", "merge", "split", "list", "border", "paste", "rewrite", "copy"])}
            pick = rng.random()
            if pick < 0.4:
                a["target"] = rng.choice(["heading", "subheading", "body", "table", "table_cell", "reference", "document", "page_break", "unknown"])
                if a["type"] in ("delete", "merge") and a["target"] == "document":
                    a["target"] = "subheading"
            elif pick < 0.85:
                a["node_ids"] = rng.sample(ids, min(len(ids), rng.choice([1, 1, 2, 3])))
            if a["type"] == "insert":
                a |= {"content": f"new {seq}.{i}. it is new", "node_type": rng.choice([None, "heading", "body", "body", "nonsense"]), "after_id": rng.choice([None, rng.choice(ids), "gone"])}
            if a["type"] == "move":
                a["to_id"] = rng.choice([str(doc), str(doc), rng.choice(ids), "gone", None])
            if a["type"] == "list":
                a |= {"kind": rng.choice([None, "number", "none"]), "level": rng.choice([None, 0, 2, 11])}
            if a["type"] == "border":
                a["sides"] = rng.choice([None, {"top": 1.5, "header": 0.5}])
            if a["type"] == "spacing":
                a |= {"line": 2.0, "after_pt": rng.choice([None, 6.0])}
            if a["type"] == "replace":
                a |= {"find": "text", "put": rng.choice([None, "TEXT"])}
            if a["type"] == "format":
                a |= {"bold": rng.choice([True, False, None]), "color": rng.choice([None, "#112233"])}
            if a["type"] == "paste":
                a["after_id"] = rng.choice([None, rng.choice(ids)])
            if a["type"] == "rewrite":
                a["edits"] = {rng.choice(ids): "rewritten text. of two parts", rng.choice(ids): " "}
            log.append(a)
    return log


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    docs = [(d, "\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 9)))) for d in range(60)]
    nodes = nodes_of_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "node_id").collect()
    ids = {d: sorted(r.node_id for r in nodes if r.doc_id == d) for d, _ in docs}
    compare(spark, docs, [a for d, _ in docs for a in random_log(rng, d, ids[d], rng.choice([0, 1, 2, 3]))])


def test_failing_versions(spark):
    docs = [(1, "Head\nSub two\nthree"), (2, "Head\nSub two\nthree"), (3, "Only")]
    actions = [
        {"doc_id": 1, "seq": 1, "i": 0, "type": "highlight", "target": "heading"},
        {"doc_id": 1, "seq": 2, "i": 0, "type": "case", "target": "heading"}, {"doc_id": 1, "seq": 2, "i": 1, "type": "delete", "node_ids": ["1.1"]},
        {"doc_id": 1, "seq": 2, "i": 2, "type": "merge", "target": "table"}, {"doc_id": 1, "seq": 2, "i": 3, "type": "highlight", "target": "document", "color": "red"},
        {"doc_id": 1, "seq": 3, "i": 0, "type": "format", "target": "heading", "bold": False},
        {"doc_id": 2, "seq": 1, "i": 0, "type": "merge", "target": "heading"}, {"doc_id": 2, "seq": 1, "i": 1, "type": "insert", "node_type": "nonsense"},
        {"doc_id": 2, "seq": 2, "i": 0, "type": "merge", "target": "document"}, {"doc_id": 2, "seq": 2, "i": 1, "type": "highlight"},
        {"doc_id": 3, "seq": 1, "i": 0, "type": "delete", "target": "document"}, {"doc_id": 3, "seq": 1, "i": 1, "type": "merge", "target": "document"}, {"doc_id": 9, "seq": 1, "i": 0, "type": "delete", "target": "body"},
    ]
    compare(spark, docs, actions)


def test_edges(spark):
    nodes = nodes_of_lines(spark.createDataFrame([(1, "Head\nx | y")], "doc_id long, text string"))
    none = replayed(spark, nodes, [])
    assert sorted((r.node_id, tuple(r.sort_path)) for r in none.collect()) == sorted((r.node_id, tuple(r.sort_path)) for r in nodes.collect())
    assert replayed(spark, nodes.limit(0), [{"doc_id": 1, "seq": 1, "i": 0, "type": "delete", "target": "table"}]).count() == 0
    with pytest.raises(Exception, match="unknown action"):
        replayed(spark, nodes, [{"doc_id": 1, "seq": 1, "i": 0, "type": "explode"}]).collect()


def test_dealt_out_once(spark):
    """However many waves there are, nothing deals the nodes out again after they were dealt out by document."""
    nodes = nodes_of_lines(spark.createDataFrame([(1, "Head\nx | y\nmore")], "doc_id long, text string"))
    log = [{"doc_id": 1, "seq": k, "i": 0, "type": t, "target": "heading"} for k, t in enumerate(["split", "delete", "merge"])]
    lines = replayed(spark, nodes, log)._jdf.queryExecution().executedPlan().toString().split("\n")
    lines = [line for line in lines if line.lstrip(" :").startswith(("+- ", "- "))]  # a newline within an expression is no line of the tree
    indent = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(k for k, line in enumerate(lines) if "text#" in line and "Scan ExistingRDD" in line)
    above, least = [], indent(lines[at])
    for line in reversed(lines[:at]):
        if indent(line) < least:
            above, least = [*above, line], indent(line)
    assert len(above) > 10 and len([line for line in above if "Exchange" in line]) == 1


def test_the_log_is_worked_out_once(spark):
    """However many waves there are, the actions are read once; documents whose log has ended wait for the others unharmed."""
    nodes = nodes_of_lines(spark.createDataFrame([(k, "Title\nA line of words. And more\nlast") for k in range(6)], "doc_id long, text string"))
    log = [(k, seq, 0, "split" if seq == 1 else "insert", "body" if seq == 1 else None, f"{k}.{seq}") for k in range(5) for seq in range(1, 2 * k + 2)]
    log += [(k, 2 * k + 2, 0, "highlight", "heading", None) for k in range(5)]
    read = spark.sparkContext.accumulator(0)

    def counted(k):
        read.add(1)
        return k

    actions = spark.createDataFrame(log, "doc_id long, seq long, i int, type string, target string, content string")
    got = S.replay(nodes, actions.withColumn("seq", F.udf(counted, "long")("seq")), waves_per_job=2).collect()
    assert read.value == len(log)
    assert {k: sum(r.doc_id == k for r in got) for k in range(6)} == {k: 3 + (2 * k if k < 5 else 0) for k in range(6)}
    marked = {r.doc_id for r in got if r.style.highlight and r.type == "heading" and r.sort_path == [1]}
    assert {0, 1, 2, 3, 4} <= marked and len({r.node_id for r in got}) == len(got)
