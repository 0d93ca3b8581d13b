"""Spelling variants, chat formatting and whitening: plain versions, round trips, odd input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradewind.llm import chat, spelling, templates, whitening

CLASHES = "word n near form x part role_ made_0 digest _id formatted mask".split()


def with_clashes(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


# --- spelling --------------------------------------------------------------------------------------------------


def plain_variants(rows, least_n):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= least_n}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near_of = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near_of[w]), form[w] and words[form[w]]))
    return out


def test_spelling_equals_the_plain_version(spark):
    dice = random.Random(3)
    letters = "abcéÿ"
    base = ["".join(dice.choice(letters) for _ in range(dice.randrange(4, 8))) for _ in range(60)]
    words = base + [w[:i] + dice.choice(letters) + w[i + dice.randrange(2) :] for w in base for i in (1, 3)] + ["aaaaa", "aaaaaa", "aaaab", "ÉCOLE×", "Ābcdef", "über日本words"]
    rows = [(i, " ".join(dice.choices(words, weights=range(1, len(words) + 1), k=400))) for i in range(40)]
    rows += [(7, None), (8, ""), (None, "Hello hello HELLO"), (9, "Hello, hello-hello"), (9, "Hello, hello-hello"), (10, "longword " * 70_000), (11, "x" * 200_000)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(rows, 3)
    assert any(f and r != f for _, f, r, *_ in got)  # a chain of two steps
    hit = [(d, w) for d, t in rows for w in set((t or "").split()) if w.isascii() and w.isalpha() and zlib.crc32(f"{'' if d is None else d}:{w.lower()}".encode()) % 97 == 0]
    assert hit  # some runs were damaged


def test_neighbours_are_all_and_distinct():
    alphabet = "abé"
    hashes = spelling.Hashes(alphabet, 15)
    everything = np.full((1 << 15) // 8, 255, np.uint8)
    for word in ("aab", "é", "abab", "bbbbb"):
        rows = np.frombuffer(word.encode("latin-1"), np.uint8)[None]
        got = [bytes(m).decode("latin-1") for _, made in hashes.neighbours(rows, everything) for m in made]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + k :] for i in range(len(word) + 1) for c in alphabet for k in (0, 1) if i + k <= len(word)}
        assert sorted(got) == sorted(want - {word})


def test_places_of_neighbours_are_those_of_the_words_they_make():
    hashes = spelling.Hashes("abcdé", 20)
    words = np.frombuffer(b"abcdeabdce", np.uint8).reshape(2, 5)
    for target in ("abce", "abcee", "abcdce", "aabdce"):
        if set(target) <= set("abcdé"):
            bitmap = np.zeros((1 << 20) // 8, np.uint8)
            for p in hashes.places(np.frombuffer(target.encode("latin-1"), np.uint8)[None]):
                bitmap[p >> np.uint64(3)] |= np.uint8(1 << int(p & np.uint64(7)))
            assert target in [bytes(m).decode("latin-1") for _, made in hashes.neighbours(words, bitmap) for m in made]


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b c"), (3, "seldom")], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0 and spelling.variants(docs.limit(0)).count() == 0


# --- templates -------------------------------------------------------------------------------------------------


def rendered(source, **scope):
    marks = {templates.BEGIN: "«", templates.END: "»", templates.TURN: ""}
    return "".join(p if isinstance(p, str) else marks[p] for p in templates.Template(source, {"upper": str.upper, "trim": str.strip}).compiled()(scope))


@pytest.mark.parametrize(("source", "want"), [
    ("", ""), ("a{# no #}b", "ab"), ("{{ 'x' + 2 }}|{{ 1 + 2 }}", "x2|3"), ("{{ none }}{{ true }}", "true"), (" {{- ' a ' | trim | upper -}} ", "A"), ("{{ 7 % 3 == 1 and not false }}", "true"),
    ("{% if u == 'a' %}1{% elif u in 'bc' %}2{% else %}3{% endif %}", "2"), ("{% set y = u + '!' %}{{ y }}", "b!"), ("{{ m['role'] }}{{ m.role }}", "rr"), ("{{ 'q' if_ }}", None), ("{{ u not in 'xyz' }}", "true"),
    ("{% for i in l %}{% if loop.first %}<{% endif %}{{ i.k }}{{ loop.index0 }}{% if loop.last %}>{% endif %}{% endfor %}", "<a0b1>"), ("{% generation %}{{ u }}{% endgeneration %}", "«b»"), ("{{ u or 'x' }}{{ '' or u }}", "bb"),
    ("{% for i in l %}{% for j in l %}{{ j.k }}{% endfor %}{{ loop.index0 }}{% endfor %}", "ab0ab1"), ("{{ \"it's\\n\" }}", "it's\n"),
    ("{% if u %}", None), ("{{ u.__class__ }}", None), ("{{ u() }}", None), ("{{ open('x') }}", None), ("{{ nothing }}", None), ("{{ u | run }}", None), ("{% import os %}", None), ("{{ l }}", None), ("{% for c in u %}{% endfor %}", None), ("{{ 1 % 0 }}", None), ("{{ u < 1 }}", None), ("{{ u %}", None), ("{% endfor %}", None), ("{{ 'a }}", None),
])
def test_template(source, want):
    scope = {"u": "b", "m": {"role": "r"}, "l": [{"k": "a"}, {"k": "b"}]}
    if want is None:
        with pytest.raises(templates.TemplateError):
            rendered(source, **scope)
    else:
        assert rendered(source, **scope) == want


def test_constants_are_folded():
    tree = templates.Template("a{% if 1 == 1 %}{{ 'b' + 'c' | upper }}{% else %}{{ x }}{% endif %}{% if false %}{{ x }}{% endif %}d{{ x or ('p' and 'q') }}", {"upper": str.upper}).tree()
    assert tree == (templates.Output(templates.Const("abCd")), templates.Output(templates.Binary("or", templates.Name("x"), templates.Const("q"))))


def test_rendering_pulls_one_message_ahead():
    pulled = []

    def messages():
        for i in range(5):
            pulled.append(i)
            yield {"k": str(i)}

    out = templates.Template("{% for m in messages %}{{ m.k }}{% endfor %}").compiled()({"messages": messages()})
    assert next(out) == "0" and pulled == [0, 1]


# --- chat ------------------------------------------------------------------------------------------------------

OTHER = chat.ChatFormat(
    template="{% for m in messages %}<|im_start|>{{ m.role | escape }}\n{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape }}{% endgeneration %}{% else %}{{ m.content | escape }}{% endif %}<|im_end|>\n{% endfor %}",
    controls=("<|im_start|>", "<|im_end|>"),
    turns=(("assistant", "<|im_start|>assistant\n", "<|im_end|>\n"),),
    other=("<|im_start|>", "\n", "<|im_end|>\n"),
)
BITS = st.lists(st.sampled_from(["<", "s>", "</", "/s>", "\\", "[INST]", "[/INST]", "[", "INST]", "<<SYS>>", "<</SYS>>", "\n", " ", "<|im_end|>", "|im_start|>", "x", "é😀", "[/ROLE]", "[\\/TURN]"]), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from([chat.INSTRUCTION, OTHER]), st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), BITS), max_size=5))
def test_what_is_formatted_is_read_back(form, turns):
    out = list(form.compiled()({"messages": [{"role": r, "content": t} for r, t in turns]}))
    text = "".join(p for p in out if isinstance(p, str))
    assert list(form.reader()(text)) == turns
    for role, content in turns:
        escaped = form.escape()(content)
        assert form.unescape()(escaped) == content and not any(c in escaped for c in form.controls)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["tool [/ROLE]", "[ROLE]", "a[", "\\"]), min_size=1, max_size=3))
def test_any_role_is_read_back(roles):
    form = chat.INSTRUCTION
    text = "".join(p for p in form.compiled()({"messages": [{"role": r, "content": "t"} for r in roles]}) if isinstance(p, str))
    assert [r for r, _ in form.reader()(text)] == roles


def test_overlapping_controls_are_refused():
    for controls in (("<s>", "x<s>y"), ("ab", "bc"), ("a\\b",), ("a",)):
        with pytest.raises(ValueError):
            chat.ChatFormat("", controls, (), ("", "", ""))


def plain_chat(rows):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    ordered = sorted(rows, key=lambda r: (*key(r), r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
    for conv, group in itertools.groupby(ordered, key=lambda r: r[0]):
        turns = [(r or "", t or "") for _, _, r, t in group]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


CHATS = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "[INST] é😀 [/INST]"), (1, 1, "assistant", "[INST] é😀 [/INST]"), (2, 0, None, None), (2, None, "assistant", None), (None, 3, "tool", "<<SYS>>"), (None, 1, "user", ""), (3, 0, "assistant", "x<s>" * 300_000), (3, 1, "user", "end")]
CHATS += [(4, i, ("user", "assistant")[i % 2], f"turn {i} <") for i in range(3000)]


@pytest.mark.parametrize("part", [1, 500, chat.PART])
@pytest.mark.parametrize("laid", [True, False])
def test_chats(spark, part, laid):
    rows = with_clashes(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").repartition(4))
    parts = chat.formatted(rows, part=part)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(parts, laid=laid).collect()}
    assert got == plain_chat(CHATS)
    sizes = {r.conv_id: r for r in parts.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.length("formatted")).alias("longest")).collect()}
    assert sizes[4].n == (1 if part == chat.PART else sizes[4].n) and (part > 500 or sizes[4].n > 50)
    assert chat.read_back(chat.formatted(rows.limit(0))).count() == 0


def test_the_mask_covers_what_the_assistant_says(spark):
    rows = spark.createDataFrame(CHATS[:2], "conv_id long, turn long, role string, text string")
    r = chat.formatted(rows).first()
    assert r.formatted == "<s>[INST] hi <\\/s> [/INST] [\\INST] é😀 [\\/INST] </s>"
    assert [r.formatted[s.start : s.end] for s in r.mask] == ["[\\INST] é😀 [\\/INST]"]


def test_broken_output_stops_the_read(spark):
    parts = spark.createDataFrame([(1, 0, "[INST] no end", [])], chat.PARTS)
    with pytest.raises(Exception, match="no turn"):
        chat.read_back(parts).collect()


# --- whitening -------------------------------------------------------------------------------------------------


def check_whitening(got, rows, components=4):
    """rows: (id, vector) that stay. Components are compared up to their sign, which is the same in all rows."""
    x = np.floor(256 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, x.shape[1])
    assert len(got) == k * len(rows) and {r.n for r in got} == {n}
    want = sorted(((i, int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)))) for (i, _), row in zip(rows, x)), key=str)
    assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 1), key=str) == want
    for c in range(1, k + 1):
        mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == c)
        theirs = (x - sums / n) @ q[:, c - 1] / np.sqrt(e[c - 1])
        byname = sorted((str(i), d, float(w)) for (i, _), d, w in zip(rows, [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))) for row in x], theirs))
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in byname])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert next(r.explained for r in got if r.component == c) == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
    assert got[0].identity_error < 1e-9


def test_whitening_equals_the_plain_version(spark):
    dice = np.random.default_rng(5)
    scales = np.array([9, 6, 4, 2, 1, 0.5, 0.2, 0.1])
    rows = [(i, (dice.normal(size=8) * scales + 3).tolist()) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(900, 1200)] + [(5, rows[5][1]), (None, rows[6][1])]
    odd = [(2001, None), (2002, [1.0] * 7 + [None]), (2003, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7), (2005, []), (2006, [1.0, 2.0]), (2007, [1e30] + [0.0] * 7)]
    df = with_clashes(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(40))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(whitening, "FAN_IN", 2)  # several levels
        check_whitening(whitening.whitened(df).collect(), rows)
    check_whitening(whitening.whitened(df.select("vec_id", F.col("embedding").cast("array<float>"))).collect(), [(i, np.float32(v).astype(float)) for i, v in rows])


def test_merging_loses_nothing():
    dice = np.random.default_rng(1)
    x = dice.integers(-900, 900, (333, 6))
    cuts = [0, 1, 3, 50, 51, 200, 333]
    one = whitening.merged(whitening.Summary.of(x[a:b]) for a, b in itertools.pairwise(cuts))
    centred = x - x.mean(axis=0)
    assert one.n == 333 and (one.sums == x.sum(axis=0)).all()
    assert np.allclose(one.factor.T @ one.factor, centred.T @ centred, rtol=1e-12)


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(same).collect()
    assert len(got) == 4 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in got)
    line = spark.createDataFrame([(i, [float(i), 0.0, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    rows = whitening.whitened(line).collect()
    assert {r.component for r in rows if r.whitened is None} == {2, 3} and rows[0].identity_error < 1e-12
    for empty in (same.limit(0), same.withColumn("embedding", F.lit(None).cast("array<double>")), spark.createDataFrame([(1, [])], same.schema)):
        assert whitening.whitened(empty).count() == 0


def test_deviations_that_need_more_than_a_word():
    model = whitening.Model(3, np.array([10**9, -(10**9)]), np.eye(2), np.ones(2), np.ones(2))
    x = np.array([[10**8, 5]])
    assert model.deviations(x) == [(3 * 10**8 - 10**9) ** 2 + (15 + 10**9) ** 2]
    with pytest.raises(OverflowError):
        whitening.Model(10**6, np.array([0, 0]), np.eye(2), np.ones(2), np.ones(2)).deviations(np.array([[10**5, 0]]))
