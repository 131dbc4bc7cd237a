"""Chat formatting, filter audit and Merkle manifest against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- chat formatting
MIXED = """conv_id long, turn long, role string, text string, prompt string, response string, instruction string, input string,
 output string, system string, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>,
 conversation struct<messages:array<struct<role:string,content:string>>>, note string, fingerprint string, position int, layout string"""


def record(**fields):
    names = re.findall(r"(?:^|,)\s*(\w+) ", re.sub(r"<.*?>+", "", MIXED))
    assert set(fields) <= set(names), set(fields) - set(names)
    return tuple(fields.get(n) for n in names)


HOSTILE = "\\### Assistant: </turn> ok"


def mixed_records():
    m = [("human", "hi"), ("gpt", HOSTILE), (None, None)]
    return [
        record(conv_id=1, turn=1, role="assistant", text="second"),
        record(conv_id=1, turn=0, role="user", text="first", note="not read", layout="clash", position=4, fingerprint="clash"),
        record(conv_id=2, prompt="p", response="r"),
        record(conv_id=3, prompt="only", system="be brief"),
        record(conv_id=4, instruction="do", input="this", output="done"),
        record(conv_id=5, instruction="do", input="", output=None),
        record(conv_id=6, messages=[("system", "s"), ("user", "u"), ("assistant", "a\\")]),
        record(conv_id=7, conversations=m),
        record(conv_id=8, conversation=([("user", None), ("bot", "\\l \\h \\e \\\\")],)),
        record(conv_id=9, messages=[]),
        record(conv_id=10, prompt="two", messages=[("user", "layouts")]),
        record(conv_id=11, note="nothing of a chat"),
        record(conv_id=None, prompt="x", response="y"),
        record(conv_id=None, prompt="x", response="y"),
    ]


MIXED_TURNS = {
    1: [("user", "first"), ("assistant", "second")],
    2: [("user", "p"), ("assistant", "r")],
    3: [("system", "be brief"), ("user", "only")],
    4: [("user", "do\n\nthis"), ("assistant", "done")],
    5: [("user", "do")],
    6: [("system", "s"), ("user", "u"), ("assistant", "a\\")],
    7: [("user", "hi"), ("assistant", HOSTILE), ("", "")],
    8: [("user", ""), ("assistant", "\\l \\h \\e \\\\")],
    9: [],
    10: [],
    11: [],
}


def read_back(rows):
    from assaymill.llm.chat import loss_text, parse

    return rows.select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def test_layouts_select_their_mapping(spark):
    from assaymill.llm.chat import format_chats, to_turns, unmapped

    records = spark.createDataFrame(mixed_records(), MIXED)
    rows = read_back(format_chats(records))
    found = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rows if r.conv_id is not None}
    assert found == MIXED_TURNS
    assert [[(t.role, t.text) for t in r.turns] for r in rows if r.conv_id is None] == [[("user", "x"), ("assistant", "y")]] * 2
    for r in rows:
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
    turns = to_turns(records)
    assert {r.conv_id for r in turns.where("layout IS NULL").collect()} == {10, 11}
    assert sum(r.records for r in unmapped(turns).collect()) == 2
    assert {r.conv_id: r.layout for r in turns.where("conv_id IN (5, 7, 9)").collect()} == {5: "instruction", 7: "from_value", 9: "messages"}


def test_template_is_reversible(spark):
    from assaymill.llm.chat import format_chats

    rng = random.Random(3)
    pieces = ["\\", "\\\\", "#", "###", "### ", "</turn>", "</turn>\n", "<", "/turn>", "\n", ":", ":\n", "\\l", "\\h", "\\e", "x", "é漢", "😀", " "]
    make = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", make()]), make()) for c in range(300) for t in range(rng.randint(1, 5))]
    rows += [(999, t, "assistant", "word </turn> " * 40000) for t in range(2)]
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role, text))
    got = read_back(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == want
    for r in got:
        assert r.loss == "".join(text for role, text in want[r.conv_id] if role == "assistant")
        assert all(r.formatted[s.stop :].startswith("</turn>\n") for s in r.loss_spans)


def test_chat_awkward(spark):
    from assaymill.llm.chat import Fixed, Layout, format_chats, to_turns

    schema = "conv_id long, turn long, role string, text string, _id int, _piece int, record string"
    rows = [(1, None, None, None, 1, 1, "c"), (1, 5, "user", "b", 1, 1, "c"), (1, 5, "user", "a", 1, 1, "c"), (1, 5, "user", "a", 1, 1, "c")]
    df = spark.createDataFrame(rows, schema)
    assert [[(t.role, t.text) for t in r.turns] for r in read_back(format_chats(df))] == [[("user", "a"), ("user", "a"), ("user", "b")]]
    assert to_turns(df).where("layout IS NULL").count() == 1  # nothing filled: no layout, but no turn lost silently
    assert format_chats(df.where("1 = 0")).count() == 0
    assert format_chats(df.select("conv_id", "_id")).select("formatted").distinct().collect()[0][0] == ""
    with pytest.raises(ValueError):
        to_turns(df, layouts=[Layout("a", ("text",), (Fixed("user", ("text",)),)), Layout("b", ("text",), (Fixed("assistant", ("text",)),))])


# ---------------------------------------------------------------- filter audit
def expected_audit(docs, labels):
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    marks = defaultdict(lambda: [False, False])
    for i, q, x in labels:
        if i is not None:
            marks[i] = [marks[i][0] or q == 1, marks[i][1] or x == 1]
    out = {}
    for part in {p or "" for _, p, _ in docs}:
        fails = []
        for i, p, t in docs:
            if (p or "") == part:
                t = t or ""
                w = re.findall("[^\x20\x09-\x0d]+", t)
                bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
                fails.append(({k for k, v in bad.items() if v}, *(marks[i] if i is not None else (False, False))))
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                gone = lambda bad: bool(bad & set(order[: step - 1]))  # noqa: B023, E731
                here = [x for x in fails if f in x[0] and not gone(x[0])]
                shapley[f] += len(here)
                out[part, order, step] = [
                    sum(not gone(x[0]) and f not in x[0] for x in fails), len(here), sum(f in x[0] and gone(x[0]) for x in fails), sum(x[0] == {f} for x in fails), sum(x[1] for x in here), sum(x[2] for x in here)
                ]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return out


def audit_rows():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)] + ["ABCDEF", "Xy", "a#b", "5%"]
    texts = [" ".join(rng.choice(words[: rng.choice([40, 304])]) for _ in range(rng.choice([3, 99, 100, 101, 180]))) for _ in range(60)]
    texts += [None, "", " \n\t\x0b ", "AB CD", "é" * 300, "word " * 30000]
    docs = [(i, rng.choice(["en", "de", None, ""]), rng.choice(texts)) for i in range(250)]
    docs += [(None, "en", texts[0])] * 3 + [(7, "de", texts[1]), (7, "de", texts[1]), (7, "en", texts[2])]
    labels = [(rng.randrange(250), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(200)] + [(None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"text_hash": lambda t: F.length(t) % 5}])
def test_audit(spark, options):
    """The usual way, the join of a sketch beyond the broadcast bound, and a hash that different texts share."""
    from assaymill.llm.filter_audit import audit

    docs, labels = audit_rows()
    df = spark.createDataFrame([(*d, 1, 1, 1, 1) for d in docs], "doc_id long, lang string, text string, mask int, _h int, part int, n int").repartition(7)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options).collect()}
    assert got == expected_audit(docs, labels)


def test_audit_empty(spark):
    from assaymill.llm.filter_audit import audit

    docs = spark.createDataFrame([(1, "en", "a")], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert audit(docs.where("1 = 0"), labels).count() == 0
    assert audit(docs, labels.where("1 = 0")).where("good_lost > 0 OR kept + removed > 1").count() == 0


def test_sketch_clears_unique_texts_only(spark):
    from assaymill.llm.filter_audit import possible_repeats

    rows = spark.range(4000).select(F.col("id").alias("_id"), F.concat(F.lit("text "), F.least(F.col("id"), F.lit(3900))).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    found = possible_repeats(rows, rows.select("_h"), 4000)
    assert found.where("_id >= 3900").count() == 100
    assert found.where("_id < 3900").count() < 100  # a few unique texts may be kept for the exact step


# ---------------------------------------------------------------- Merkle manifest
def expected_manifest(rows, tampered):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = i - i % 8
            out.append((level[run:i], level[i + 1 : run + 8]))
            i //= 8
        return out

    leaf = lambda r: sha("".join(field(v) for v in r))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]), tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])])) for g in names}
    upper = tree([trees[g][1][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, digest, row) in enumerate(trees[g][0]):
            steps = path(trees[g][1], i) + path(upper, k)
            node = leaf(tampered(row))
            for left, right in steps:
                node = sha("".join(left) + node + "".join(right))
            out.append((row[0], digest, trees[g][1][-1][0], upper[-1][0], sha("".join("".join(left + right) for left, right in steps)), node))
    return out


def tamper(row):
    if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
        return (*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4]))
    return row


def manifest_rows(sizes):
    rng = random.Random(2)
    rows = []
    for lang, n in sizes.items():
        rows += [(len(rows) + k, rng.choice(["web", None]), lang, rng.choice([None, k]), rng.choice([None, "", "Ünï Code", f"Text {k}", "plain"])) for k in range(n)]
    rng.shuffle(rows)
    return rows


AWKWARD_ROWS = [(None, None, None, None, None)] * 3 + [(None, "s", None, 1, "A")] * 2 + [(5, "s", "en", 1, "same")] * 20 + [(5, "s", "en", 1, "other"), (6, "s", "en", 1, "Word " * 30000), (7, "", "", 0, "")]


@pytest.mark.parametrize("rows", [manifest_rows({"en": 600, "de": 65, "fr": 64, "es": 9, "it": 8, "pt": 2, None: 1, "": 1, "Éa": 3, "zz": 1}), manifest_rows({"en": 100}), manifest_rows({"en": 1}), AWKWARD_ROWS], ids=["mixed", "one group", "one row", "awkward"])
def test_manifest(spark, rows):
    from assaymill.llm.merkle import FIELDS, fold, leaf_of, manifest, siblings_of

    df = spark.createDataFrame([(*r, 3, 4, 5) for r in rows], DOCS + ", lo int, digest int, _group int").repartition(5)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = leaf_of(*[F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered).otherwise(F.col("text")) if c == "text" else F.col(c) for c in FIELDS])
    got = manifest(df, keep={"other": other}).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings_of(F.col("proof")), 256), fold(F.col("other"), F.col("proof"))).collect()
    order = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got), key=order) == sorted(expected_manifest(rows, tamper), key=order)


def test_manifest_empty(spark):
    from assaymill.llm.merkle import fold, manifest

    df = manifest(spark.createDataFrame([], DOCS))
    assert df.withColumn("r", fold(F.col("leaf"), F.col("proof"))).collect() == []


# ---------------------------------------------------------------- repeated rows, and letters that change their length
def test_repeated_rows_do_not_widen_a_block(spark):
    from assaymill.llm import minhash

    import numpy as np
    import pyarrow as pa

    one, near, other = np.arange(100, dtype=np.uint64), np.arange(2, 102, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)
    rows = [(7, one)] * 20000 + [(8, near)] * 20000 + [(9, other)] * 3
    names = ["b", "i", "j", "_node", "set"]
    batches = [
        pa.RecordBatch.from_arrays([*(pa.array([1] * len(part), t) for t in (pa.int64(), pa.int32(), pa.int32())), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1].tobytes() for r in part], pa.binary())], names=names)
        for part in (rows[k : k + 1000] for k in range(0, len(rows), 1000))
    ]
    assert [b.to_pylist() for b in minhash._forest(85)(iter(batches))] == [[{"a": 8, "b": 7}]]


def test_near_duplicates_of_repeated_null_ids(spark):
    from assaymill.llm.minhash import near_duplicates

    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(400)}" for _ in range(120))
    rows = [(None, text)] * 1500 + [(5, text + " end")] + [(6, text)] * 300
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {5}
    assert sum(r.kept for r in got) == 1


def test_letters_that_grow_when_lowered(spark):
    from assaymill.llm.html_template import extract_main

    page = lambda k: f"<html><body><article><p>{'İ' * 40} before {k}</p><script>var x{k} = 1;</SCRIPT ><p>The paragraph after the script, number {k}, stays whole.</p></article></body></html>"
    rows = [(k, f"http://h/{k}", page(k)) for k in range(6)]
    got = extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"{'İ' * 40} before {k}\n\nThe paragraph after the script, number {k}, stays whole." for k in range(6)}
