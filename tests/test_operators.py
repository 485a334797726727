import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowmill.functions import text as T
from knowmill.functions.vector import cosine_distance, distance_score, l2_squared
from knowmill.operators import code, context, graph, hierarchy, ingest, retrieval, symbols
from knowmill.operators.embedding import HashEmbedder, embed
from knowmill.plans import reference
from knowmill.sources.files import agent_usage, audit_log, ignore_pattern, source_tree
from knowmill.sources.schemas import TABLES, violations
from knowmill.sources.store import InvalidRows, Store
from knowmill.streaming import activity


def test_scores(spark):
    rows = spark.createDataFrame([(0.0,), (2.0,), (0.5,), (1.0,), (-1.0,), (3.0,)], "d double").select(distance_score(F.col("d")).alias("s")).collect()
    assert [r["s"] for r in rows] == [1.0, 0.0, 0.75, 0.5, 1.0, 0.0]


def test_distances(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 2.0]), (2, [1.0, 1.0], [2.0, 2.0]), (3, None, [1.0, 1.0]), (4, [0.0, 0.0], [1.0, 1.0]), (5, [1.0], [1.0, 1.0])], "i int, a array<float>, b array<float>")
    got = {r["i"]: (r["c"], r["l"]) for r in rows.select("i", F.round(cosine_distance(F.col("a"), F.col("b")), 9).alias("c"), l2_squared(F.col("a"), F.col("b")).alias("l")).collect()}
    assert got == {1: (1.0, 5.0), 2: (0.0, 2.0), 3: (None, None), 4: (None, 2.0), 5: (None, None)}


def test_globs():
    assert T.glob_to_like("src/**/*.ts") == "src/%/%.ts"
    assert T.glob_to_like("src/?.ts") == "src/_.ts"
    assert T.glob_to_like("a_b%") == r"a\_b\%"


def test_tags_and_summary(spark):
    r = spark.createDataFrame([("|a_b|c|", "x" * 500)], "t string, x string").select(T.has_tag(F.col("t"), "a_b"), T.has_tag(F.col("t"), "b"), T.has_tag_loosely(F.col("t"), "a_b"), F.length(T.summary(F.col("x")))).first()
    assert tuple(r) == (True, False, True, 403)


def test_bm25_and_fusion(spark):
    rows = spark.createDataFrame([("a", "red fox"), ("b", "red red dog"), ("c", "blue"), ("d", None)], "id string, content string")
    got = {r["id"]: r["bm25"] for r in retrieval.bm25(rows, "red RED fox", "id").collect()}
    avg, n = 6 / 4, 4
    part = lambda df, tf, dl: np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({"a": part(2, 1, 2) + part(1, 1, 2), "b": part(2, 2, 3)})
    assert retrieval.bm25(rows.where("false"), "red", "id").count() == 0
    assert [r["id"] for r in retrieval.hybrid_search(rows.withColumn("vector", F.array(F.lit(1.0).cast("float"))), None, "fox", "id").collect()] == ["a"]


def test_precedents_against_brute_force(spark, sf):
    import hashlib

    rows = {r["decision_id"]: r for r in spark.read.parquet(f"{sf}/decisions.parquet").withColumn("at", F.try_to_timestamp("created_at")).collect()}
    expected = {}
    for i, r in rows.items():
        if int(hashlib.md5(i.encode()).hexdigest()[-7:], 16) % 50 == 0 and r["vector"] is not None and len(r["vector"]) == 64:
            near = [(round(sum((x - y) ** 2 for x, y in zip(r["vector"], b["vector"])), 9), j) for j, b in rows.items() if b["vector"] is not None and len(b["vector"]) == 64 and b["status"] == "active" and (b["project_id"], b["decision_type"]) == (r["project_id"], r["decision_type"]) and b["at"] < r["at"]]
            if near:
                expected[i] = (min(near)[1], round(min(near)[0], 6))
    got = {r["decision_id"]: (r["precedent"], r["distance"]) for r in reference.vec_precedents(spark, sf).collect()}
    assert got == expected


@pytest.mark.parametrize("links, nodes", [([], set()), ([("a", "b"), ("b", "c")], set()), ([("a", "b"), ("b", "a")], {"a", "b"}), ([("a", "a")], {"a"}), ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], set()), ([("x", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "y")], {"a", "b", "c"}),
    # two cycles and a bridge between them, a shared node, a long chain into a cycle and out of it
    ([("a", "b"), ("b", "a"), ("b", "m"), ("m", "n"), ("n", "x"), ("x", "y"), ("y", "x")], {"a", "b", "x", "y"}),
    ([("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("z", "a"), ("c", "q"), ("q", "q")], {"a", "b", "c", "q"}),
    ([(f"k{i:02}", f"k{i + 1:02}") for i in range(12)] + [("k09", "k07")], {"k07", "k08", "k09"}),
    ([("z", "a"), ("a", "b"), ("b", "a")], {"a", "b"}),
])
def test_cycles(spark, links, nodes):
    e = spark.createDataFrame(links, "a string, b string")
    assert {r["node"] for r in graph.cyclic_nodes(e).collect()} == nodes


def test_blocked(spark):
    e = spark.createDataFrame([("r1", "p", "task_depends_on", "a", "b", "t"), ("r2", "p", "task_depends_on", "c", "d", "t"), ("r3", "p", "task_depends_on", "e", "nowhere", "t")], "relationship_id string, project_id string, type string, a string, b string, created_at string")
    t = spark.createDataFrame([(k, k, s, x, b, why) for k, s, x, b, why in [("a", "pending", False, True, None), ("b", "pending", False, False, None), ("c", "pending", False, True, "why"), ("d", "pending", True, None, None), ("e", "pending", False, True, "why"), ("f", "pending", False, True, "")]], "k string, task_id string, status string, is_cancelled boolean, is_blocked boolean, block_reason string")
    assert {r["task_id"]: r["blocked"] for r in graph.blocked_tasks(e, t).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": True, "f": False}


@pytest.mark.parametrize("seed", range(6))
def test_budget_fill_is_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    tokens, budget = [int(x) for x in rng.integers(0, 60, rng.integers(0, 30))], int(rng.integers(0, 200))
    rows = spark.createDataFrame([("p", "document", f"{i:03}", n, -float(i), 0, None) for i, n in enumerate(tokens)], "project_id string, kind string, id string, tokens int, score double, priority int, updated timestamp")
    used, expected = 0, []
    for i, n in enumerate(tokens):
        if used + n <= budget:
            used += n
            expected.append((f"{i:03}", used))
    assert [(r["id"], r["used"]) for r in context.budget_fill(rows, budget).orderBy("place").collect()] == expected


@pytest.mark.parametrize("seed", range(3))
def test_budget_fill_reaches_the_last_candidate(spark, seed):
    rng = np.random.default_rng(seed)
    tokens, budget = [40] * 4 + [50] * 300 + [int(x) for x in rng.integers(0, 45, 400)] + [0, 1, 1], 200
    at = [None if x == 0 else f"2024-01-{x:02} 10:00:00" for x in rng.integers(0, 28, len(tokens))]
    rows = [("p", ["code", "document"][int(k)], f"{i:03}", n, float(s), int(p), u) for i, (n, k, s, p, u) in enumerate(zip(tokens, rng.integers(0, 2, len(tokens)), rng.integers(0, 3, len(tokens)), rng.integers(0, 3, len(tokens)), at))]
    rows += [("q", "document", f"{i:03}", 5000 if i < 250 else 60, 1.0, 0, None) for i in range(255)]
    expected = []
    for project in "pq":
        mine = sorted((r for r in rows if r[0] == project), key=lambda r: r[2])
        mine.sort(key=lambda r: r[6] or "", reverse=True)
        mine.sort(key=lambda r: r[5])
        mine.sort(key=lambda r: (r[4], r[1]), reverse=True)
        used = 0
        for place, r in enumerate(mine, 1):
            if used + r[3] <= budget:
                used += r[3]
                expected.append((project, place, *r[1:4], used))
    frame = spark.createDataFrame(rows, "project_id string, kind string, id string, tokens int, score double, priority int, updated string").withColumn("updated", F.col("updated").cast("timestamp"))
    assert max(x[1] for x in expected) > 200
    assert sorted(tuple(r) for r in context.budget_fill(frame, budget).collect()) == sorted(expected)


def paragraphs(text):
    import re

    out, now = [], ""
    for p in re.split(r"\n\n+", text):
        if now and len(now) + len(p) + 2 > 50:
            out.append(now.strip(" "))
            now = now[-10:] + "\n\n" + p
        else:
            now = p if not now else now + "\n\n" + p
    return out + ([now.strip(" ")] if now.strip(" ") else [])


def test_chunkers(spark):
    texts = ["", "short", "x" * 120, "one two\n\nthree four five six seven\n\n\neight nine ten eleven twelve\n\nz", "a" * 60 + "\n\nb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {}
    for r in ingest.fixed_chunks(rows, ["id"], size=50, overlap=10).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["content"])
    for i, t in enumerate(texts):
        n = 1 if len(t) <= 50 else -(-(len(t) - 10) // 40)
        assert got[i] == [t[40 * k : 40 * k + 50] for k in range(n)]
    got = {i: [] for i in range(len(texts))}
    for r in ingest.paragraph_chunks(rows, ["id"], size=50, overlap=10).orderBy("id", "chunk_index").collect():
        got[r["id"]].append(r["content"])
    assert got == {i: paragraphs(t) for i, t in enumerate(texts)}


def test_line_parts(spark):
    text = "\n".join(f"l{i}" for i in range(1, 451))
    rows = ingest.line_parts(spark.createDataFrame([(1, text), (2, "a\nb")], "id int, content string"), ["id"]).orderBy("id", "part").collect()
    assert [(r["part"], r["parts"], r["first_line"], r["content"].split("\n")[0], r["content"].split("\n")[-1]) for r in rows] == [(1, 3, 1, "l1", "l200"), (2, 3, 181, "l181", "l380"), (3, 3, 361, "l361", "l450"), (1, 1, 1, "a", "b")]


def test_symbol_parts(spark):
    long = "import os\n\ndef big():\n" + "\n".join(f"    x{i} = {i}" for i in range(449)) + "\n\ndef small():\n    pass\n"
    found = symbols.symbols(spark.createDataFrame([("k", "a.py", long), ("l", "b.md", long), ("m", "c.py", None)], "key string, file string, content string"), "key", "file")
    rows = ingest.symbol_parts(found, "key").orderBy("first_line", "part").collect()
    lines = long.split("\n")
    assert [(r["symbol_name"], r["first_line"], r["last_line"]) for r in rows] == [("big (part 1/3)", 3, 202), ("big (part 2/3)", 183, 382), ("big (part 3/3)", 363, 452), ("small", 454, 455)]
    assert all(r["content"] == f"File: a.py | function: {r['scope_chain']}\n\n" + "\n".join(lines[r["first_line"] - 1 : r["last_line"]]) for r in rows)


def test_sections_against_the_stated_rules():
    assert ingest.sections("# A\n\nshort text") == ["# A\n\nshort text"]
    text = "# T\n\nintro\n## One\n" + "a b c. " * 20 + "\n## Two\n" + "x" * 30 + "\n\n" + "y" * 30
    got = ingest.sections(text, 60, 10)
    assert got[0] == "# T\n\nintro" and all(0 < len(c) <= 60 for c in got) and any(c.startswith("## Two\nx") for c in got) and got[-1].endswith("y" * 30)
    assert ingest.sections("z" * 100, 40, 10) == ["z" * 40, "z" * 40, "z" * 40] and ingest.sections("", 40, 10) == [] and ingest.sections(" \n\n ", 3, 1) == []
    # the last parts of up to the overlap are repeated
    assert ingest.sections("aaaa bbbb cccc dddd", 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]


def test_document_chunks_by_strategy(spark):
    long = "para one. " * 30 + "\n\n" + "para two. " * 190
    rows = [("plan", "## H\nbody"), ("glossary", long), ("dependency", long), ("unheard", "x"), ("glossary", ""), ("plan", ""), ("plan", None), (None, "y"), ("plan", long)]
    docs = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(rows)], "id int, category string, content string")
    got = {}
    for r in ingest.document_chunks(docs, ["id"]).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["content"])
    assert set(got) == set(range(len(rows))) and [got[i] for i in (0, 3, 4, 5, 6, 7)] == [["## H\nbody"], ["x"], [""], [""], [""], ["y"]]
    assert got[2] == [long[:2000], long[1800:]] and len(got[1]) == 2 and got[8] == ingest.sections(long)


def test_changes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    got = ingest.changes(frame([("a", "1"), ("b", "1"), ("c", "1"), ("e", None)]), frame([("a", "1"), ("b", "2"), ("d", "1"), ("e", None)]))
    assert {r["path"]: r["change"] for r in got.collect()} == {"a": "same", "b": "changed", "c": "deleted", "d": "new", "e": "changed"}


PY = '''"""Doc: def no()."""
import os, sys as system
from . import utils
from ..models import (
    User,
)
X = {"def": 1}

@dataclass
class D:
    @property
    def p(self):
        return 1
    def q(self): return 2

class A(Base):
    """class B: pass"""

    def run(self, a=(1,
        2)):
        def inner():
            pass
        return 1

    @staticmethod
    async def stop():
        pass  # end

    class Nested:
        pass

@app.route("/x")
@other
def free(
    a,
):
    return 2
# trailing
'''
TS = '''import { a } from "./a"; // import x from "y"
export { baz, qux as q } from "./baz";
export interface I {
  a: string;
}
export type U = "a"
  | { c: number };
export const f = async (x: number): Promise<{ a: string }> => {
  return `class ${x} {`;
};
const N = 3, M = new Map<string, Session>();
export async function go<T extends { id: string }>(x: T): Promise<{ n: number }> {
  if (x) { class Inner {} }
}
function sig(a: string): void;
export default class Store<T> extends Base<T> {
  constructor(private a: string) { super(); }
  static async load<T>(x: T): Promise<T[]> {
    return [];
  }
  abstract foo(): void;
}
const enum E { A = 1 }
'''
RS = '''use std::{fmt, io::Read};
mod sub;
pub(crate) const N: usize = 3;
#[derive(Debug)]
pub struct P<'a> { x: &'a str, c: char }
pub enum Q { A, B { x: i32 } }
pub trait Draw: Send { fn draw(&self); fn twice(&self) { self.draw(); } }
impl<T: Into<String>> Draw for P<T> where T: Clone {
    pub fn go(&self) -> char { '{' }
}
type Alias = Vec<u8>;
mod tests { use super::*; pub fn t() {} }
fn broken() {
    let x = 1;
'''


def test_symbols(spark):
    rows = spark.createDataFrame([("a.py", PY), ("b.ts", TS), ("src\\c.rs", RS), ("d.md", "class X"), ("e.py", None), ("f.rs", "")], "file string, content string")
    found = symbols.outlines(rows, "file", "file")
    got = {r["path"]: [(s["symbol_type"], s["scope_chain"], s["start_line"], s["end_line"], s["is_overview"]) for s in r["symbols"]] for r in found.collect()}
    assert got == {
        "a.py": [("class", "D", 9, 14, True), ("method", "D.q", 14, 14, False), ("class", "A", 16, 30, True), ("method", "A.run", 19, 23, False), ("method", "A.stop", 25, 27, False), ("function", "free", 32, 37, False)],
        "b.ts": [
            ("interface", "I", 3, 5, False), ("type_alias", "U", 6, 7, False), ("function", "f", 8, 10, False), ("constant", "N", 11, 11, False), ("constant", "M", 11, 11, False),
            ("function", "go", 12, 14, False), ("class", "Store", 16, 22, True), ("method", "Store.constructor", 17, 17, False), ("method", "Store.load", 18, 20, False), ("enum", "E", 23, 23, False),
        ],
        "src/c.rs": [
            ("constant", "N", 3, 3, False), ("struct", "P", 5, 5, True), ("enum", "Q", 6, 6, False), ("trait", "Draw", 7, 7, True), ("method", "Draw.twice", 7, 7, False),
            ("impl", "P<T>", 8, 10, True), ("method", "P<T>.go", 9, 9, False), ("type_alias", "Alias", 11, 11, False), ("method", "tests.t", 12, 12, False), ("function", "broken", 13, 14, False),
        ],
        "e.py": [], "f.rs": [],
    }
    links = {r["path"]: (r["imports"], r["exports"]) for r in found.collect()}
    assert links["a.py"] == (["os", "sys", ".", "..models"], [])
    assert links["b.ts"] == (["./a", "./baz"], ["I", "U", "f", "go", "default", "baz", "qux"])
    assert links["src/c.rs"] == (["std::{fmt, io::Read}", "sub", "super::*"], [])
    one = symbols.symbols(rows, "file", "file").where("symbol_name = 'P<T> for Draw'").first()
    assert one["content"].startswith("impl<T: Into<String>> Draw") and one["content"].endswith("}")


def test_symbols_of_damaged_files():
    for language in ("python", "typescript", "rust"):
        for text in ("{{{", ")]}", "'\"`", "class", "def ", "fn", "export", "impl", "@", "class A {", "\0", "const", "/*", '"""', "mod x {", "export {", "import"):
            symbols.read_file(text, language)


@pytest.mark.parametrize(
    "language, here, what, files, target",
    [
        ("typescript", "src/a/x.ts", "./y", ["src/a/y.ts"], "src/a/y.ts"), ("typescript", "src/a/x.ts", "../b/y", ["src/b/y/index.tsx"], "src/b/y/index.tsx"),
        ("typescript", "src/a/x.ts", "zod", ["src/a/zod.ts"], None), ("typescript", "src/a/x.ts", "../y.ts", ["src/y.ts"], "src/y.ts"),
        ("python", "p/a/x.py", ".y", ["p/a/y.py"], "p/a/y.py"), ("python", "p/a/x.py", "..b.y", ["p/b/y/__init__.py"], "p/b/y/__init__.py"), ("python", "p/a/x.py", "p.b", ["p/b.py"], "p/b.py"),
        ("rust", "k/src/a/x.rs", "crate::b::y", ["k/src/b/y.rs", "k/src/b.rs"], "k/src/b/y.rs"), ("rust", "k/src/a/x.rs", "crate::b::Type", ["k/src/b.rs"], "k/src/b.rs"),
        ("rust", "k/src/a/x.rs", "self::y", ["k/src/a/y/mod.rs"], "k/src/a/y/mod.rs"), ("rust", "k/src/a/x.rs", "super::y::Z", ["k/src/a/y.rs"], "k/src/a/y.rs"), ("rust", "k/src/a/x.rs", "std::fmt", ["k/src/fmt.rs"], None),
    ],
)
def test_imports(spark, language, here, what, files, target):
    imports = spark.createDataFrame([("p", here, language, what)], "project_id string, file_path string, language string, import string")
    found = code.import_edges(imports, spark.createDataFrame([("p", f) for f in files], "project_id string, path string")).collect()
    assert [r["to_path"] for r in found] == ([target] if target else [])


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "id int, t string")
    got = {r["id"]: r["vector"] for r in embed(rows, "t", HashEmbedder(8), 8).collect()}
    assert got[1] == got[2] and not any(got[3]) and abs(sum(x * x for x in got[4]) - 1) < 1e-6
    cache = spark.createDataFrame([("c",)], "t string").select(F.sha2("t", 256).alias("text_hash"), F.array(*[F.lit(7.0).cast("float")] * 8).alias("vector"))
    assert {r["id"]: r["vector"] for r in embed(rows, "t", HashEmbedder(8), 8, cache).collect()}[4] == [7.0] * 8
    with pytest.raises(Exception, match="vectors of 8 numbers"):
        embed(rows, "t", HashEmbedder(8), 9).collect()


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), dim=4)
    assert store.create() == (8, 0) and store.create() == (0, 8)
    at = "2024-01-01T00:00:00Z"
    rel = spark.createDataFrame([(f"r{i}", "p", "a", "b", "references", "manual", at, None) for i in range(3)], TABLES["relationships"][0])
    store.append("relationships", rel)
    store.update("relationships", F.col("relationship_id") == "r1", {"type": F.lit("implements")})
    store.delete("relationships", F.col("relationship_id") == "r2")
    store.upsert("relationships", rel.where("relationship_id = 'r0'").withColumns({"created_at": F.lit("2025-01-01T00:00:00Z"), "to_id": F.lit("c")}))
    assert {r["relationship_id"]: (r["type"], r["to_id"], r["created_at"]) for r in store.current("relationships").collect()} == {"r0": ("references", "c", at), "r1": ("implements", "b", at)}
    with pytest.raises(InvalidRows, match="from_id is missing"):
        store.append("relationships", rel.withColumn("from_id", F.lit(None).cast("string")))
    assert store.current("relationships").count() == 2
    store.audit("p", "link_documents", "r0", "relationship", {"count": 1})
    assert json.loads(store.current("activity_log").first()["metadata"]) == {"count": "1"}


def test_violations(spark):
    rows = spark.createDataFrame([("", "p", "d", 0, "x", [1.0], "h", 1, "active", 1, "no time")], TABLES["doc_chunks"][0])
    assert {r["rule"] for r in violations(rows, "doc_chunks", 4).collect()} == {"chunk_id is blank", "vector has another length", "created_at is no time"}


def test_source_tree(spark, tmp_path):
    for path, text in {"src/a.ts": "x", "src/a.test.ts": "y", "src/b.py": "z", "node_modules/m.ts": "n", "gen/c.rs": "g", "readme.md": "r"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r["path"]: (r["language"], r["is_test"], r["content"]) for r in source_tree(spark, str(tmp_path), exclude=["gen/"]).collect()}
    assert got == {"src/a.ts": ("typescript", False, "x"), "src/a.test.ts": ("typescript", True, "y"), "src/b.py": ("python", False, "z")}
    assert ignore_pattern("*.log") == r"(^|/)[^/]*\.log(/|$)"


def test_audit_log(spark, tmp_path):
    lines = [{"tool": "x_a", "agent": "one", "input_tokens": 100, "output_tokens": 10}, {"tool": "x_b", "agent": "", "input_tokens": 1, "output_tokens": 0}, {"tool": "y", "agent": "one", "input_tokens": 9, "output_tokens": 9}]
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(x) for x in lines] + ["{broken"]))
    got = {r["agent"]: (r["calls"], r["input_tokens"], r["cost"]) for r in agent_usage(audit_log(spark, str(tmp_path / "log.jsonl")), "x_").collect()}
    assert got == {"one": (1, 100, 0.0005), "unknown": (1, 1, 0.0)}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_days_of_the_stream_in_any_zone(spark, tmp_path, zone):
    rows = [("l1", "a", "2024-01-01T23:00:00-05:00"), ("l1", "a", "2024-01-01T23:00:00-05:00"), ("l2", "a", "2024-01-02T01:00:00Z"), ("l3", "b", None), ("l4", "b", "2023-01-01T00:30:00Z"), ("l2", "a", "2024-01-02T01:00:00Z")]
    fields = ", ".join(f"{f.name} string" for f in TABLES["activity_log"][0])
    for i, (log_id, action, at) in enumerate(rows):  # a file each, so several batches and rows that come late
        r = spark.createDataFrame([(log_id, "p", "x", action, None, None, None, at)], fields)
        r.coalesce(1).write.mode("append").parquet(f"{tmp_path}/activity_log.parquet")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        whole = {(r["day"], r["action"]): r["n"] for r in activity.ingest(spark, str(tmp_path)).collect()}
        some = {(r["day"], r["action"]): r["n"] for r in activity.live(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert whole == {("2024-01-02", "a"): 2, (None, "b"): 1, ("2023-01-01", "b"): 1}
    assert some.get(("2024-01-02", "a")) == 2 and set(some) <= set(whole)


def counted(rows):
    return rows.withColumn("tokens", T.token_estimate(F.col("content"))).drop("content")


def test_detailed_context(spark):
    docs = spark.createDataFrame([("p", k, k.upper(), "active", "x" * n) for k, n in [("a", 40), ("b", 40), ("c", 400), ("d", 20)]], "project_id string, k string, doc_id string, status string, content string")
    asked = spark.createDataFrame([("p", "a")], "project_id string, k string")
    near = spark.createDataFrame([("a", "B", 2), ("a", "C", 1), ("a", "D", 3), ("a", "A", 1)], "here string, related_id string, nearness int")
    got = [(r["part"], r["id"], r["used"]) for r in context.detailed(asked, counted(docs), near, 25).collect()]
    assert sorted(got, key=str) == sorted([("requested", "A", None), ("related", "B", 20), ("related", "D", 25)], key=str)


def test_detailed_context_of_a_hub(spark):
    """Small neighbours after place 200, a code chunk among the requests, and another project's document."""
    n = 300
    docs = spark.createDataFrame([("p", "hub", "HUB", "active", "x" * 40), *[("p", f"d{i:03}", f"D{i:03}", "active", "x" * (400 if i < 250 else 20)) for i in range(n)], ("q", "far", "FAR", "active", "x")], "project_id string, k string, doc_id string, status string, content string")
    code = spark.createDataFrame([("p", "C1", "y" * 8), ("q", "C2", "y"), ("p", "HUB", "no")], "project_id string, chunk_id string, content string")
    asked = spark.createDataFrame([("p", "r1", "hub"), ("p", "r1", "c1"), ("p", "r1", "c2"), ("p", "r2", "d000")], "project_id string, request string, k string")
    near = spark.createDataFrame([*[("hub", f"D{i:03}", 1) for i in range(n)], *[(f"d{i:03}", "HUB", 1) for i in range(n)], ("hub", "FAR", 1)], "here string, related_id string, nearness int")
    got = {(r["request"], r["part"], r["id"], r["used"]) for r in context.detailed(asked, counted(docs), near, 30, counted(code), ("project_id", "request")).collect()}
    assert got == {("r1", "requested", "HUB", None), ("r1", "requested", "C1", None), ("r1", "related", "D250", 17), ("r1", "related", "D251", 22), ("r1", "related", "D252", 27), ("r2", "requested", "D000", None)}
    wide = context.detailed(asked.where("k = 'hub'").select("project_id", "k"), counted(docs), near, 30)
    assert [r["id"] for r in wide.where("part = 'related'").orderBy("used").collect()] == ["D250", "D251", "D252", "D253"]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_detailed_context_against_brute_force(spark, size):
    folder = f"/root/testdata/{size}"
    clean, cost = lambda x: (x or "").strip().lower(), lambda x: -(-len(x) // 4)
    kb = {}
    for r in spark.read.parquet(f"{folder}/kb_documents.parquet").collect():
        if r["doc_id"] not in kb or kb[r["doc_id"]]["version"] < r["version"]:
            kb[r["doc_id"]] = r
    live = {clean(i): r for i, r in kb.items() if r["status"] != "superseded"}
    chunks = {clean(r["chunk_id"]): r for r in spark.read.parquet(f"{folder}/code_chunks.parquet").select("chunk_id", "project_id", "content").collect()}
    near = {}
    for r in spark.read.parquet(f"{folder}/relationships.parquet").collect():
        for a, b in [(clean(r["from_id"]), clean(r["to_id"])), (clean(r["to_id"]), clean(r["from_id"]))]:
            if a and b in live:
                near.setdefault(a, {})[b] = min(near.get(a, {}).get(b, 99), graph.NEARNESS.get(r["type"], 99))
    expected = set()
    for k, r in {**chunks, **live}.items():
        used = cost(r["content"])
        expected.add((r["project_id"], k, "requested", r["doc_id"] if k in live else r["chunk_id"], used, None))
        for _, i, b in sorted((rank, live[b]["doc_id"], b) for b, rank in near.get(k, {}).items() if b != k and live[b]["project_id"] == r["project_id"]):
            if used + cost(live[b]["content"]) <= 4000:
                used += cost(live[b]["content"])
                expected.add((r["project_id"], k, "related", i, cost(live[b]["content"]), used))
    assert {tuple(r) for r in reference.ctx_detailed(spark, folder).select("project_id", "request", "part", "id", "tokens", "used").collect()} == expected


def test_new_edges_and_what_if(spark):
    e = spark.createDataFrame([("p", "t", "a", "b"), ("p", "t", "b", "c")], "project_id string, type string, a string, b string")
    asked = spark.createDataFrame([("p", "t", "a", "b"), ("p", "t", "c", "a"), ("p", "u", "a", "b")], "project_id string, type string, a string, b string")
    assert {(r["type"], r["a"], r["b"]) for r in graph.new_edges(e, asked).collect()} == {("t", "c", "a"), ("u", "a", "b")}
    assert graph.new_edges(e, asked, True).count() == 5
    one = spark.createDataFrame([("b",)], "node string")
    assert {(r["a"], r["b"]) for r in graph.what_if(e, one, asked).collect()} == {("a", "b"), ("c", "a")}
    assert graph.cyclic_nodes(graph.what_if(e, one.where("false"), asked)).count() == 3
