"""BPE, decontamination, quality, LM scores and chat formatting."""

import json
import math
import random

import numpy as np
import pytest


from gridspark.llm import bpe, chat, decontaminate, lm, quality, queries

from ..conftest import DATA, same_rows
from .helpers import corpus, sha, words

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def odd_texts(n: int) -> list[str]:
    rng = random.Random(4)
    letters = [chr(c) for c in [*range(1, 0x250), 0x3A3, 0x3C2, 0x130, 0x2028, 0x85, 0x1C, 0xA0, 0x1680, 0x200B, 0x3000, 0x301, 0x1E9E, 0xFB01, 0x212B, 0xAC00, 0x1F600, 0x660, 0x2160, 0xB2]]
    bits = ["<|startoftext|>", "<|endoftext|>", "'s", "'LL", " ", "a", "é", "ΑΣ", "Σ", "\n", "1²", "<|endoftext", "don't"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_encoding_is_the_library_s(spark, tokenizer):
    docs = [*corpus(1), *((1000 + k, t) for k, t in enumerate(odd_texts(300)))]
    out = {r.doc_id: r for r in bpe.encoded(spark.createDataFrame(docs, SCHEMA), queries.tokenizer_path(), decoded=True).collect()}
    for k, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        whole = tokenizer.decode(ids, skip_special_tokens=False)
        r = out[k]
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, whole)
        assert (r.ids_sha256, r.decoded_sha256) == (sha(" ".join(map(str, ids))), sha(whole))


def test_decoding_from_ids(spark):
    df = bpe.encoded(spark.createDataFrame(corpus(2), SCHEMA), queries.tokenizer_path(), decoded=True)
    back = bpe.decoded(df.withColumnRenamed("decoded", "want"), queries.tokenizer_path())
    assert back.where("decoded <> want or decoded is null").count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    t = bpe.Tokenizer(open(queries.tokenizer_path(), encoding="utf-8").read())
    first = t.encode("one two three four five six seven eight nine ten eleven")
    assert t.encode("one two three four five six seven eight nine ten eleven") == first
    assert len(t.young) <= 5 and len(t.old) <= 5


def test_merges_by_brute_force():
    """The lowest rank first, of equal ones the first place; on random words, repeats and bytes outside ASCII."""
    spec = json.loads(open(queries.tokenizer_path(), encoding="utf-8").read())["model"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(spec["merges"])}
    t = bpe.Tokenizer(open(queries.tokenizer_path(), encoding="utf-8").read())
    rng, letters = random.Random(21), bpe.byte_letters()
    words = ["".join(rng.choices("etaoinshrd" if k % 2 else "aéßжü!-日", k=rng.randint(1, 30))) for k in range(300)] + ["a" * 50, "anan" * 9]
    for word in words:
        want = [letters[b] for b in word.encode()]
        want[-1] += spec["end_of_word_suffix"]
        while (best := min((rank.get(p, 1 << 40), i) for i, p in enumerate([*zip(want, want[1:]), ("", "")])))[0] < 1 << 40:
            want[best[1] : best[1] + 2] = ["".join(want[best[1] : best[1] + 2])]
        assert t.merged(word) == want


def test_cache_size_can_be_given(spark):
    """What a worker's cache may hold is the caller's, so op2_bpe keeps more words than the pipeline, and merges fewer again."""
    t = bpe.Tokenizer(open(queries.tokenizer_path(), encoding="utf-8").read())
    t.cache, made, merged = 8, [], t.merged
    t.merged = lambda w: made.append(w) or merged(w)
    for _ in range(3):
        t.encode("one two three four five six seven eight")
    assert len(made) == 8 and len(t.young) <= 8
    df = spark.createDataFrame([(k, "ab cd ef gh " * 3) for k in range(4)], "doc_id long, text string")
    rows = lambda **options: sorted(map(repr, bpe.encoded(df, queries.tokenizer_path(), **options).collect()))
    assert rows(cache=2) == rows()


def test_encoding_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 7), (1, "", 7), (1, "", 7)], "doc_id long, text string, n_tokens int")
    assert [(r.n_tokens, r.ids, r.ids_sha256) for r in bpe.encoded(df, queries.tokenizer_path()).collect()] == [(0, [], sha(""))] * 3
    assert bpe.encoded(df.limit(0), queries.tokenizer_path()).count() == 0


def brute_contamination(docs, items, width=13):
    def split(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")

    clean = lambda t: [w for w in split(t) if w]
    windows = {}
    for item, text in items:
        w = clean(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for k, text in docs:
        w, found = clean(text), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[tuple(w[i : i + n])]
        n = sum(hit)
        out[k] = (len(w), n, len(found), sha(",".join(sorted(found))), n > 0 and 20 * n >= len(w))
    return out


def contaminated_corpus():
    rng = random.Random(3)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([40, 13, 12, 3, 1, 25, 30])] + [(7, None), (8, " .,; "), (9, "Straße ÉA É-a")]
    docs = corpus(1)
    for k, (_, text) in enumerate(items):
        some = (text or "").split()
        docs.append((2000 + k, " ".join([*words(rng, 30), *some, *words(rng, 30)]).upper()))
        docs.append((3000 + k, ", ".join(some[: len(some) // 2 + 1])))
        docs.append((4000 + k, " ".join([*words(rng, 900), *some[:14]])))
    return docs, items


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_contamination(spark, block):
    docs, items = contaminated_corpus()
    out = decontaminate.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), spans=True, block_bytes=block).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out} == brute_contamination(docs, items)
    for r in out:
        if r.n_hit:
            assert len(decontaminate.words_of(r.cleaned)) == r.n_words - r.n_hit
        else:
            assert r.cleaned is None


def test_contamination_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x", 5), (2, "", "y", 6)], "doc_id long, text string, contaminated string, n_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination(docs, none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in rows] == [(0, 0, False)] * 2
    assert decontaminate.decontaminated(docs, none).columns == docs.columns
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_gradient_of_the_fit():
    rng = np.random.default_rng(6)
    docs = [(rng.integers(0, 3, (k, quality.WIDTH)).astype(np.uint8), np.ones(k), k % 2) for k in (1, 2, 3, 5, 70)]
    chains = quality.Chains(docs)
    theta = rng.normal(0, 0.3, quality.WEIGHTS + 4)
    value, grad = chains.likelihood(theta)
    for k in [*rng.choice(np.flatnonzero(grad[: quality.WEIGHTS]), 12), *range(quality.WEIGHTS, quality.WEIGHTS + 4)]:
        step = np.zeros_like(theta)
        step[k] = 1e-5
        slope = (chains.likelihood(theta + step)[0] - chains.likelihood(theta - step)[0]) / 2e-5
        assert abs(slope - grad[k]) < 1e-6
    # One chain of two lines against all four labellings.
    bins, y = docs[1][0], docs[1][2]
    e, t = theta[quality.slots(bins)].sum(axis=1), theta[quality.WEIGHTS :].reshape(2, 2)
    score = {(a, b): a * e[0] + b * e[1] + t[a, b] for a in (0, 1) for b in (0, 1)}
    alone = quality.Chains([docs[1]])
    assert np.isclose(alone.likelihood(theta)[0] / alone.weight[0], score[y, y] - np.log(sum(map(np.exp, score.values()))))


def test_quality_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Some good line.", 5.5, "p", "i"), (2, None, 6.5, "q", None)], "doc_id long, text string, Score double, _y string, id string")
    labels = spark.createDataFrame([(1, 1, "z"), (2, 0, "z")], "doc_id long, quality int, text string")
    model = quality.trained(df, labels)
    assert quality.scored(df, model).columns == ["doc_id", "text", "_y", "id", "score", "predicted"]
    model.slope, model.offset = 0.0, 9.0
    assert sorted(map(tuple, quality.kept(df, model).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(TypeError):
        quality.trained(spark.createDataFrame([("a", "b")], "doc_id string, text string"), labels)


def test_decontaminated_keeps_own_columns(spark):
    item = " ".join(f"w{k}" for k in range(13))
    rows = [(1, "clean words", 99, "a", "h"), (2, item, 98, "b", "i"), (3, None, 97, None, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_words long, _items string, _hit string")
    bench = spark.createDataFrame([("x", item), ("y", None), (None, "")], "item_id string, text string")
    for size in (1 << 20, 0):
        assert sorted(map(tuple, decontaminate.decontaminated(df, bench, block_bytes=size).collect())) == [rows[0], rows[2]]
        got = decontaminate.contamination(df, bench, block_bytes=size).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r.n_items, r._items) for r in got] == [(2, 0, 0, "a"), (13, 13, 1, "b"), (0, 0, 0, None)]
        assert decontaminate.contamination(df, bench.limit(0), block_bytes=size).where("n_hit > 0").count() == 0
        assert decontaminate.contamination(df.limit(0), bench, block_bytes=size).count() == 0


def test_backoff_by_brute_force(spark):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 12)))) for k in range(12)] + [(20, "x y z x y z"), (21, "x y z x y z"), (-(2**63), "a b")]
    words_ = {k: t.split() for k, t in docs}
    log = lambda x: round(1e6 * math.log(x))
    got = {r.id: r for r in lm.backoff_scores(spark.createDataFrame(docs, SCHEMA)).collect()}
    for k, w in words_.items():
        others = [v for j, v in words_.items() if j != k]
        count = lambda g: sum(v[i : i + len(g)] == g for v in others for i in range(len(v) - len(g) + 1))
        score, levels = 0, [0, 0, 0]
        for i in range(len(w)):
            off = 0
            for n in range(min(3, i + 1), 0, -1):
                seen = count(w[i - n + 1 : i + 1])
                if n == 1 or seen:
                    score += log(max(seen, 1)) - log(count(w[i - n + 1 : i]) if n > 1 else max(1, sum(map(len, others)))) + off
                    levels[n - 1] += 1
                    break
                off += log(0.4)
        assert (got[k].score_micro, [got[k].n_1, got[k].n_2, got[k].n_3]) == (score, levels)


def test_quality_on_held_out_labels(spark):
    big = DATA.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.trained(docs, labels)
    rows = quality.scored(docs, model).join(labels, "doc_id").where(quality.held_out()).select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert area > 0.99 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97


def test_marginals_by_enumeration():
    import itertools
    import math

    import numpy as np

    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=quality.WEIGHTS), rng.normal(size=(2, 2)))
    bins, _ = quality.line_bins("One line here.\nTHE NEXT!! ONE!!\n\nand | a | third\nlast")
    e = model.weights[quality.slots(bins)].sum(axis=1)
    weight = {y: math.exp(sum(e[k] * v for k, v in enumerate(y)) + sum(model.steps[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(bins))}
    total = sum(weight.values())
    want = [sum(w for y, w in weight.items() if y[k]) / total for k in range(len(bins))]
    assert np.allclose(model.marginals(bins), want)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "a line\n" * 5000), (None, "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.trained(docs, none)
    assert [(r.score, r.predicted) for r in quality.scored(docs, model).collect()] == [(0.5, 1)] * 4
    some = spark.createDataFrame([(1, 1), (2, 1), (2, None), (3, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, quality.trained(docs, some)).collect())
    assert quality.scored(docs.limit(0), model).count() == 0


def test_backoff_scores(spark, duck):
    out = lm.backoff_scores(spark.read.parquet(f"{DATA}/documents.parquet")).withColumnRenamed("id", "doc_id")
    same_rows(out, duck.sql(queries.OP8_SQL))


def test_backoff_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b a")], SCHEMA)
    rows = sorted((r.id or -1, r.n_words, r.n_1) for r in lm.backoff_scores(df).collect())
    assert rows == [(-1, 2, 2), (1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1)]
    assert lm.backoff_scores(df.limit(0)).count() == 0


def test_chat_query(spark, duck):
    same_rows(queries.op9_chat(spark, DATA), duck.sql(queries.OP9_SQL))


def test_chat_escapes_are_reversible(spark):
    rng = random.Random(7)
    parts = ["<|turn|>", "<|text|>", "<|end|>", "</s>", "[INST]", "[/INST]", "\\", "\\0", "\\1", "\\2", "<", "[", "x", "\n", "é", "😀", ""]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for c in range(150) for t in range(4)]
    back = chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for r in back:
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(x.role, x.text) for x in r.turns] == [(x[2], x[3]) for x in own] and r.valid
        assert r.loss_text == "".join(x[3] for x in own if x[2] == "assistant")
        assert not any(c in r.formatted for c in ("[INST]", "[/INST]", "</s>")) and r.formatted.count("<|turn|>") == 4


def test_chat_order_machine_and_nulls(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "user", "u"), (3, 0, "user", None), (3, 1, None, None), (3, None, "user", "first"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (4, 1, "user", "b"), (4, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, None: True, 4: False}
    assert [(t.role, t.text) for t in got[3].turns] == [("user", "first"), ("user", ""), ("", "")]
    assert [t.text for t in got[4].turns] == ["a", "b"]
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_runs_no_python(spark):
    plan = chat.read_back(chat.formatted(spark.read.parquet(f"{DATA}/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))


def test_chat_query_runs_the_machine(spark):
    plan = queries.op9_chat(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert all(k in plan for k in ("invalid", "answered", "told"))


def test_sql_of_the_other_queries(spark, duck):
    for name in ("op3_decontaminate", "op7_suffix", "op10_substring"):
        same_rows(queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name]))


def test_names(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
