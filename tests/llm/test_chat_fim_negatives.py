"""Chat formatting, fill-in-the-middle and hard negatives against plain Python versions, and on awkward tables."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("tracklake.llm")

TEXTS = ["</s>[INST] ok [/INST]", "␛", "␛␛[INST]", "<<<SYS>>>", "[␛INST]", "<s", "[[OUT]]", "<|endoftext|>", "a\n b \r\n\t", "", None, "é" * 3, "[/ROLE][ROLE]", "x" * 70_000, "<s></s>" * 3000, "ends ␛"]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", None, "", "[INST]", "Assistant"]
    rows = [(c, t, rng.choice(roles), rng.choice(TEXTS), "clash") for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [rows[0], rows[5], (50, 1, "user", "b", ""), (50, 1, "user", "a", ""), (50, None, "assistant", "first", ""), (None, 0, "assistant", "no id", ""), (None, None, None, None, None)]
    return rows


def turns_of(rows):
    out = {}
    for c, t, r, x, _ in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def test_chat(spark, chats):
    from tracklake.llm import chat_format as cf
    from tracklake.llm.queries import tokenizer_path

    df = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string, ids string").repartition(3)
    got = {r.conv_id: r for r in cf.read_chat(cf.format_chat(df, tokenizer_path()), tokenizer_path()).collect()}
    want = turns_of(chats)
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss_text == "".join(x for role, x in turns if role == "assistant")
        ids, mask = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.loss_mask, np.uint8)
        assert len(ids) == len(mask) and not mask[ids > 50_256].any() and 50_256 not in ids
        # The formatted text alone tells the turns: no mark in it comes from a text.
        marks = re.compile("|".join(re.escape(m) for m in cf.control_strings()))
        assert len(marks.findall(r.formatted)) == int((ids > 50_256).sum())
        parts = re.findall(r"<<SYS>>(.*?)<</SYS>>|\[INST\](.*?)\[/INST\]|\[OUT\](.*?)</s>|\[ROLE\](.*?)\[/ROLE\](.*?)\[/TURN\]", r.formatted.removeprefix("<s>"), re.S)
        assert [cf.unescaped("".join(p[:3]) + p[4]) for p in parts] == [x for _, x in turns]
    assert cf.format_chat(df.limit(0), tokenizer_path()).count() == 0


def test_chat_ids_are_those_of_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from tracklake.llm import chat_format as cf
    from tracklake.llm.queries import tokenizer_path

    own = tokenizers.Tokenizer.from_file(tokenizer_path())
    df = spark.createDataFrame([(1, 0, "user", "Hello there, you."), (1, 1, "assistant", "It's  fine.\n")], "conv_id long, turn long, role string, text string")
    r = cf.format_chat(df, tokenizer_path()).first()
    ids = np.frombuffer(r.ids, "<u4").tolist()
    base = 50_257
    assert ids == [base, base + 3, *own.encode("Hello there, you.", add_special_tokens=False).ids, base + 4, base + 5, *own.encode("It's  fine.\n", add_special_tokens=False).ids, base + 6]
    assert r.formatted == "<s>[INST]Hello there, you.[/INST][OUT]It's  fine.\n</s>"


def test_escape_is_reversible(spark):
    from tracklake.llm import chat_format as cf

    rng = random.Random(8)
    pieces = [*cf.control_strings(), "␛", "<", "[", "S", "/", ">", "a"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", cf.escaped(df.text).alias("e")).collect():
        assert not any(c in r.e for c in cf.control_strings()) and cf.unescaped(r.e) == r.text


def plain_fim(key, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    h = sha(f"{seed}:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (n, "plain", None, None, text)
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return (n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    from tracklake.llm.fill_in_middle import fill_in_middle

    rng = random.Random(1)
    texts = ["a <P> b", "<M>", "  \n ", "<S ends <", "> begins <P", "é\x0b\x0c ü x \x1c y", "one", "", None, "word " * 30_000]
    rows = [(k, rng.choice(texts) if k % 3 else " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 30))), "clash", "x") for k in range(300)]
    rows += [rows[4], rows[4], (None, "no id", "", ""), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fim string, output string").repartition(3)
    got = sorted(repr((r.doc_id, r.text, r.output, r.fim.n, r.fim.form, r.fim.prefix_chars, r.fim.middle_chars, r.fim.output, r.fim.output_sha256, r.fim.restored_sha256)) for r in fill_in_middle(df).collect())
    want = []
    for k, t, _, o in rows:
        w = plain_fim(k, t)
        want.append(repr((k, t, o, *w, sha(w[4]), sha(t or ""))))
    assert got == sorted(want)
    assert {r.fim.form for r in fill_in_middle(df).select("fim").collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0


def brute(rows):
    """The contract over distinct (id, label, vector) rows; null, NaN and infinite components take no part."""
    kept = {}
    for i, v, y, *_ in rows:
        if i is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept[(i, y, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v))] = None
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for a, ya, va in kept:
        if a % 100:
            continue
        scored = {(-dot(va, v), i, y == ya) for i, y, v in kept if i != a}
        same = sorted({(s, i) for s, i, own in scored if own})[:5]
        other = sorted({(s, i) for s, i, own in scored if not own})
        for s, p in same:
            found = [(t, i) for t, i in other if 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("large", [1, 5000])
def test_hard_negatives(spark, monkeypatch, large):
    from pyspark.sql import functions as F

    from tracklake.llm import hard_negatives as hn

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = []
    for k in range(900):
        v = centres[k % 6] + rng.normal(size=8) * 0.4
        rows.append((k, [float(x) * large for x in v[: 5 + k % 4]], int(k % 5), "clash"))
    hot = [0.5 * large] * 8
    rows += [(k, hot, k % 2, "") for k in range(1000, 1300)]  # one vector of many rows
    rows += [rows[100], rows[100], rows[7], (201, rows[3][1], 4, ""), (None, hot, 1, ""), (1400, None, 1, ""), (1401, hot, None, ""), (1500, [float("nan")] * 8, 1, ""), (1501, [None, 1.0], 1, ""), (1600, [float("inf"), 0.0], 2, ""), (1700, [], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, d string").repartition(4)
    monkeypatch.setattr(hn, "TILE", 5)
    monkeypatch.setattr(hn, "CHUNK_BYTES", 200)  # several chunks
    got = sorted(tuple(r) for r in hn.hard_negatives(df, F.col("id") % 100 == 0).collect())
    want = brute(rows)
    assert len(want) > 50 and got == want
    assert hn.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert hn.hard_negatives(df.where("vec_id = 7"), F.col("id") % 100 == 0).columns == [c.split(" ")[0] for c in hn.COLUMNS.split(", ")]


def test_brackets_hold_the_score():
    from tracklake.llm import hard_negatives as hn

    rng = np.random.default_rng(9)
    x = rng.integers(-200, 200, (400, 12))
    x[:50] = x[0]
    top = int((x * x).sum(1).max())
    pivots = hn.choose_pivots(x[:100], top)
    dx, q = hn.distances(hn._augmented(x, top), pivots), x[::40]
    dq = hn.distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
    least, most = hn.brackets(dq, dx, (q * q).sum(1), top)
    s = q @ x.T
    assert (least <= s).all() and (s <= most).all() and (most < top).any()


def test_best_keeps_the_first_of_all():
    from tracklake.llm.hard_negatives import Best

    rng = random.Random(2)
    best, seen = Best(4, 3), [set() for _ in range(4)]
    for _ in range(30):
        part = [(rng.randrange(3), rng.randrange(9), rng.randrange(30)) for _ in range(rng.randrange(12))]
        for q, s, i in part:
            seen[q].add((-s, i))
        best.enter(*(np.array([p[k] for p in part], np.int64) for k in range(3)))
        for q in range(4):
            want = sorted(seen[q])[:3]
            assert best.count[q] == len(want)
            assert list(zip(-best.score[q][: len(want)], best.id[q][: len(want)], strict=True)) == want
