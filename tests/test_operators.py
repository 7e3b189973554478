from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.operators import annotation, attention, curate, folds, gates, keyed, metrics, timings, tokens
from tonegap.sources import lines


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- gates ------------------------------------------------------------------

POSTS = [
    ("a", 1, "prompt سلام دنیا", True, True),  # spam, blocks only where spam blocks
    ("a", 2, "سلام دنیا", True, True),
    ("a", 3, "سلام دنیا", True, True),
    ("b", 4, "سلام دنیا", True, False),  # no face blocks everywhere
    ("b", 5, "سلام دنیا", True, True),
    ("c", 6, "", True, True),
    ("d", 7, "hello", True, True),
    ("d", 8, "سلام", False, True),
    ("d", 9, "سلام", True, True),
    ("e", 10, "سلام", True, True),  # known
]


@pytest.mark.parametrize(
    "rules, accepted",
    [
        (gates.FEED, {("a", 2), ("d", 9)}),
        (gates.LOCAL, {("c", 6), ("d", 9)}),
        (gates.EMBED, {("d", 9)}),
    ],
)
def test_gate_rules(spark, rules, accepted):
    posts = frame(spark, POSTS, "post_id string, ord long, caption string, media_ok boolean, face_ok boolean")
    seen = frame(spark, [("e",)], "post_id string")
    out = gates.gate(posts, rules, seen=seen, media_ok=F.col("media_ok"), face_ok=F.col("face_ok"))
    assert {(r["post_id"], r["ord"]) for r in out.collect()} == accepted


def test_gate_counts_add_up(spark):
    posts = frame(spark, POSTS, "post_id string, ord long, caption string, media_ok boolean, face_ok boolean")
    judged = gates.verdicts(posts, gates.FEED, media_ok=F.col("media_ok"), face_ok=F.col("face_ok"))
    counts = {r["reason"]: r["n"] for r in gates.gate_counters(judged, gates.FEED).collect()}
    assert counts == {"spam": 1, "accepted": 3, "duplicate": 2, "no_face": 1, "wrong_script": 2, "no_media": 1}
    assert {r[0] for r in gates.newly_ignored(judged).collect()} == {"a", "b"}


def test_costly_columns_are_computed_once(spark):
    posts = frame(spark, POSTS, "post_id string, ord long, caption string, media_ok boolean, face_ok boolean")
    plan = gates.gate(posts, gates.FEED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "WindowGroupLimit" in plan


# --- keyed ------------------------------------------------------------------


def test_running_sum_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.randint(0, 5)) for k in ("hot", "cold") for p in range(200 if k == "hot" else 3)]
    out = keyed.running_sum(frame(spark, rows, "k string, p long, v int"), ["k"], "p", F.col("v"), "total", block=7)
    got = {(r["k"], r["p"]): r["total"] for r in out.collect()}
    for key in ("hot", "cold"):
        total = 0
        for _, p, v in [r for r in rows if r[0] == key]:
            total += v
            assert got[key, p] == total


@pytest.mark.parametrize("digits", [1, 2])
def test_folds_are_balanced_and_independent_of_the_cut(spark, digits):
    rows = [(f"p{i}", "hot" if i % 3 else "cold") for i in range(97)]
    df = frame(spark, rows, "post_id string, label string")
    out = folds.stratified_folds(df, hex_digits=digits)
    sizes = {}
    for r in out.collect():
        sizes.setdefault(r["label"], [0] * 5)[r["fold"] - 1] += 1
    assert all(max(s) - min(s) <= 1 for s in sizes.values())
    base = {r["post_id"]: r["fold"] for r in folds.stratified_folds(df, hex_digits=1).collect()}
    assert base == {r["post_id"]: r["fold"] for r in out.collect()}


def test_upsert_keeps_duplicates_of_the_batch(spark):
    old = frame(spark, [("a", 1), ("b", 1)], "post_id string, v int")
    new = frame(spark, [("b", 2), ("b", 3), ("c", 2)], "post_id string, v int")
    out = sorted(tuple(r) for r in keyed.upsert(old, new).collect())
    assert out == [("a", 1), ("b", 2), ("b", 3), ("c", 2)]
    again = sorted(tuple(r) for r in keyed.upsert(keyed.upsert(old, new), new).collect())
    assert again == out


# --- annotation -------------------------------------------------------------


def test_majority_ties(spark):
    log = frame(
        spark,
        [
            ("p", "neutral", "t1", 1),
            ("p", "positive", "t2", 2),  # tie, latest timestamp
            ("q", "neutral", "t1", 3),  # tie, equal timestamps: earliest row
            ("q", "positive", "t1", 4),
            ("r", "negative", "t1", 5),
            ("r", "negative", "t1", 6),  # repeats count
            ("r", "positive", "t9", 7),
        ],
        "post_id string, label string, timestamp string, ord long",
    )
    got = {r["post_id"]: r["label"] for r in annotation.majority_label(log).collect()}
    assert got == {"p": "positive", "q": "neutral", "r": "negative"}


def _kappa(a, b):
    n = len(a)
    agreed = sum(x == y for x, y in zip(a, b))
    chance = sum(a.count(k) * b.count(k) for k in K.LABELS)
    return 0.0 if chance >= n * n else (agreed * n - chance) / (n * n - chance)


@pytest.mark.parametrize("part_size", [2, 512])
def test_kappa_against_brute_force(spark, part_size):
    rng = random.Random(3)
    labels = {(a, p): rng.choice(K.LABELS[:3]) for a in "abcdefg" for p in range(12) if rng.random() < 0.7}
    labels |= {(a, 99): "positive" for a in "abcdefg"}  # a crowded post
    rows = [(a, str(p), x) for (a, p), x in labels.items()]
    latest = frame(spark, rows, "annotator_id string, post_id string, label string")
    pairs = annotation.annotator_pairs(latest, part_size)
    got = {(r["annotator_a"], r["annotator_b"]): (r["overlap"], r["kappa"]) for r in annotation.cohens_kappa(pairs).collect()}
    for a in "abcdefg":
        for b in "abcdefg":
            shared = [p for p in [*range(12), 99] if (a, p) in labels and (b, p) in labels]
            if a < b and shared:
                n, kappa = got[a, b]
                assert n == len(shared)
                assert kappa == pytest.approx(_kappa([labels[a, p] for p in shared], [labels[b, p] for p in shared]))


@pytest.mark.parametrize("n", [5, 6, 7])
def test_kappa_single_class_is_zero(spark, n):
    rows = [(a, str(p), "positive") for a in "ab" for p in range(n)]
    latest = frame(spark, rows, "annotator_id string, post_id string, label string")
    assert annotation.cohens_kappa(annotation.annotator_pairs(latest)).first()["kappa"] == 0.0


def test_latest_annotation(spark):
    rows = [("p", "neutral", "a", 1), ("p", "positive", "a", 2), ("p", "bad", "a", 3), ("p", "negative", None, 4), ("q", "negative", "", 5)]
    log = frame(spark, rows, "post_id string, label string, annotator_id string, ord long")
    got = {tuple(r) for r in annotation.latest_annotation(log).collect()}
    assert got == {("a", "p", "positive"), ("_unknown_", "p", "negative"), ("_unknown_", "q", "negative")}


# --- metrics ----------------------------------------------------------------


def test_fold_metrics(spark):
    rows = [(1, "positive", "positive"), (1, "positive", "negative"), (1, "negative_sarcasm", "negative_sarcasm"), (2, "neutral", "neutral")]
    per_fold = metrics.fold_metrics(metrics.confusion(frame(spark, rows, "fold int, label string, pred string")))
    got = {r["fold"]: r.asDict() for r in per_fold.collect()}
    assert got[1]["accuracy"] == pytest.approx(2 / 3)
    assert got[1]["f1_positive"] == pytest.approx(2 / 3) and got[1]["f1_negative"] == 0.0
    assert got[1]["macro_f1"] == pytest.approx((2 / 3 + 1) / 5)
    assert got[1]["sarcasm_accuracy"] == 1.0 and got[2]["sarcasm_accuracy"] is None


def test_threshold_rule_against_brute_force(spark):
    rng = np.random.default_rng(0)
    grid = np.linspace(K.THRESHOLD_START, K.THRESHOLD_STOP, K.THRESHOLD_STEPS)
    scores = np.concatenate([rng.random(150), grid, [0.0, 1.0]])
    y = (scores + rng.normal(0, 0.3, len(scores)) > 0.5).astype(int)
    fold = np.arange(len(scores)) % 5 + 1
    rows = [(int(f), float(s), int(v)) for f, s, v in zip(fold, scores, y)]
    df = frame(spark, rows, "fold int, Dsem double, y int")
    got = {r["fold"]: r for r in metrics.dsem_rule(df).collect()}
    steps = {(r["fold"], r["step"]): r["accuracy"] for r in metrics.threshold_grid(df).collect()}
    start, step = metrics.threshold_values()
    values = [start + i * step for i in range(K.THRESHOLD_STEPS)]
    for f in range(1, 6):
        train = fold != f
        acc = [float(np.mean((scores[train] >= t) == y[train])) for t in values]
        assert [steps[f, i] for i in range(len(values))] == pytest.approx(acc)
        best = values[int(np.argmax(np.round(acc, 12)))]
        assert got[f]["threshold"] == pytest.approx(best)
        assert got[f]["accuracy"] == pytest.approx(float(np.mean((scores[~train] >= best) == y[~train])))


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 57])
def test_timing_quantiles(spark, n):
    import statistics

    rng = random.Random(n)
    values = [rng.choice([0.0, 0.5, rng.random() * 100]) for _ in range(n)]
    rows = [("s", v, 10) for v in values]
    r = timings.stage_timing_summary(frame(spark, rows, "stage string, latency_s double, peak_bytes long")).first()
    p95 = statistics.quantiles(values, n=20)[18] if n >= 20 else max(values)
    assert r["median_latency_s"] == pytest.approx(statistics.median(values))
    assert r["p95_latency_s"] == pytest.approx(p95)
    assert r["under_1gib_budget"]


# --- tokens and attention ---------------------------------------------------


def token_frame(spark, words, scores=None):
    scores = scores or list(range(len(words)))
    rows = [("p", i, w, float(s)) for i, (w, s) in enumerate(zip(words, scores))]
    return frame(spark, rows, "post_id string, pos long, token string, score double")


@pytest.mark.parametrize(
    "words, order",
    [
        (["[CLS]", "a", "b", "[SEP]"], ["[CLS]", "b", "a", "[SEP]"]),
        (["a", "[UNK]", "b"], ["b", "[UNK]", "a"]),
        (["[CLS]", "[SEP]"], ["[CLS]", "[SEP]"]),
    ],
)
def test_rtl_remap(spark, words, order):
    out = tokens.rtl_remap(token_frame(spark, words)).orderBy("pos").collect()
    assert [r["token"] for r in out] == order
    assert sorted(r["score"] for r in out) == [float(i) for i in range(len(words))]


@pytest.mark.parametrize(
    "words, shown",
    [
        (["زیبایی", "!"], ["زیبایی!"]),
        (["##ها", "ها"], ["ها", "ها"]),
        (["▁سلام", "▁", "##م", "…"], ["سلامم…"]),
        (["!", "?", "a"], ["!?", "a"]),
    ],
)
def test_merge_tokens(spark, words, shown):
    out = tokens.merge_tokens(token_frame(spark, words)).orderBy("start").collect()
    assert [r["text"] for r in out] == shown


def test_anchors_and_scaling(spark):
    only = tokens.strip_anchors(token_frame(spark, ["[CLS]", "[SEP]"]))
    assert only.count() == 2
    out = tokens.word_heatmap(token_frame(spark, ["[CLS]", "a", "b", "c"], [9, -2.5, 0.5, 10.0])).orderBy("start")
    assert [r["normalized"] for r in out.collect()] == pytest.approx([0.0, 3 / 12.5, 1.0])
    with pytest.raises(Exception, match="differ in number"):
        spark.range(1).select(
            tokens.pair_tokens(F.array(F.lit("a")), F.array(F.lit(1.0), F.lit(2.0)))
        ).collect()


@pytest.mark.parametrize("layers, residual", [(1, True), (4, True), (6, False)])
def test_rollout_against_numpy(spark, layers, residual):
    rng = np.random.default_rng(layers)
    raw = rng.random((layers, 3, 5, 5))
    raw /= raw.sum(axis=-1, keepdims=True)
    rows = [("p", *map(int, idx), float(v)) for idx, v in np.ndenumerate(raw)]
    rows = [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows]
    df = frame(spark, rows, "post_id string, layer int, head int, i int, j int, w double")
    want = None
    for layer in raw:
        m = layer.mean(axis=0)
        if residual:
            m = m + np.eye(5)
            m /= m.sum(axis=-1, keepdims=True)
        want = m if want is None else m @ want
    out = np.zeros((5, 5))
    for r in attention.rollout(df, layers, residual=residual).collect():
        out[r["i"], r["j"]] = r["w"]
    assert np.allclose(out, want)
    row = {r["j"]: r["score"] for r in attention.cls_rollout(df, layers, residual=residual).collect()}
    assert [row[j] for j in range(5)] == pytest.approx(list(want[0]))


def test_rollout_errors(spark):
    df = frame(spark, [("p", 0, 0, 0, 0, 1.0)], "post_id string, layer int, head int, i int, j int, w double")
    with pytest.raises(ValueError):
        attention.fuse_heads(df, "median")
    with pytest.raises(ValueError):
        attention.rollout(df, 0)
    with pytest.raises(ValueError):
        attention.cls_scores(df, 5, seq_len=3)


# --- curation ---------------------------------------------------------------


def test_expand_terms_against_brute_force(spark):
    specs = [(1, "ab", True), (2, "Plain", False), (3, "zzz", True), (4, "B", True), (5, "#ab", True)]
    tags = ["xABy", "b", "ab", "plain", "cab", "q"]
    out = curate.expand_terms(
        frame(spark, specs, "ord long, term string, search boolean"),
        frame(spark, list(enumerate(tags)), "ord long, tag string"),
        max_tags=2,
    )
    want, seen = [], set()
    for ord_, term, search in specs:
        needle = term.lstrip("#").lower()
        found = [t for t in tags if needle in t.lower()][:2] if search else []
        for tag in found or [term]:
            if tag.lower() not in seen:
                seen.add(tag.lower())
                want.append((ord_, tag))
    assert [(r["ord"], r["tag"]) for r in out.orderBy("ord", "tag_ord").collect()] == want


def test_search_terms_keep_all_tags(spark):
    tags = [f"tag{k:02}" for k in range(40)]
    out = curate.expand_terms(
        frame(spark, [(1, "ag", True)], "ord long, term string, search boolean"),
        frame(spark, list(enumerate(tags)), "ord long, tag string"),
    )
    assert [r["tag"] for r in out.orderBy("tag_ord").collect()] == tags


def test_null_latencies_do_not_count(spark):
    rows = frame(spark, [("s", 1.0, 5), ("s", None, 9), ("s", 3.0, 7), ("t", None, 1)], "stage string, latency_s double, peak_bytes long")
    got = {r["stage"]: (r["n_samples"], r["median_latency_s"], r["peak_bytes"]) for r in timings.stage_timing_summary(rows).collect()}
    assert got == {"s": (2, 2.0, 9)}


def test_prune_and_paths(spark):
    pool = frame(spark, [("a", "x", "/d/a.jpg"), ("b", "y", "/d/b.jpg"), ("c", "z", "/d/c.jpg")], "post_id string, caption string, image_path string")
    log = frame(spark, [("a", "me"), ("b", "you")], "post_id string, annotator_id string")
    media = frame(spark, [("/d/b.jpg",)], "path string")
    kept, archived = curate.prune_pool(pool, log, "me", archive_media_dir="/arch/", media=media)
    assert [r["post_id"] for r in kept.collect()] == ["a"]
    assert {r["post_id"]: r["image_path"] for r in archived.collect()} == {"b": "/arch/b.jpg", "c": "/d/c.jpg"}
    paths = frame(spark, [("w\\x\\a.jpg",), ("",), ("/images/b.jpg",)], "image_path string")
    moved = {r["image_path"]: r["changed"] for r in curate.rewrite_media_paths(paths, "/images").collect()}
    assert moved == {"/images/a.jpg": True, "": False, "/images/b.jpg": False}


# --- exact selection, arrays of tokens, agreement in blocks ------------------


def test_dense_bins_are_split(spark, monkeypatch):
    """Values that one bin of the first histogram holds, far ones, and many copies, against sorting."""
    monkeypatch.setattr(timings, "SMALL", 16)
    rng = random.Random(5)
    dense = [1.0 + rng.random() * 1e-9 for _ in range(3000)]
    sets = {
        "dense": dense,
        "far": [10.0 ** rng.uniform(-300, 300) for _ in range(500)],
        "copies": [2.5] * 900 + [2.5000001] * 50,
        "signs": [rng.choice([-1, 1]) * rng.random() for _ in range(700)] + [float("inf"), float("-inf")],
        "one": [7.0],
    }
    rows = [(k, v) for k, own in sets.items() for v in own] + [("one", None), ("one", float("nan")), ("none", None)]
    ranks = {"lo": F.lit(1), "mid": F.floor((F.col("n") + 1) / 2), "high": F.col("n"), "no": F.col("n") + 1}
    df = frame(spark, rows, "stage string, x double").repartition(5)
    got = {r["stage"]: r for r in timings.values_at_ranks(df, "stage", "x", ranks).collect()}
    assert set(got) == set(sets)
    for k, own in sets.items():
        own = sorted(own)
        assert (got[k]["n"], got[k]["lo"], got[k]["mid"], got[k]["high"], got[k]["no"]) == (len(own), own[0], own[(len(own) + 1) // 2 - 1], own[-1], None)


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))


def test_a_heatmap_takes_one_exchange(spark):
    rng = random.Random(2)
    words = ["[CLS]", "a", "##b", "▁c", "!", "▁", "[SEP]", "…"]
    rows = [(f"p{k}", i, rng.choice(words), float(rng.randrange(9))) for k in range(30) for i in range(rng.randrange(1, 12))]
    df = frame(spark, rows, "post_id string, pos long, token string, score double")
    heat = tokens.word_heatmap(df, remap=True)
    assert exchanges(heat) == 1
    shown = tokens.merge_tokens(tokens.strip_anchors(tokens.rtl_remap(df)))
    want = tokens.minmax_normalize(shown).select("post_id", "start", "text", "score", "normalized")
    assert sorted(map(tuple, heat.collect())) == sorted(map(tuple, want.collect()))


def test_merging_is_a_loop_over_pieces(spark):
    """Islands by a plain loop, for random posts."""
    rng = random.Random(9)
    words = ["a", "##b", "!", "▁c", "▁", "##", "?!"]
    posts = {f"p{k}": [rng.choice(words) for _ in range(rng.randrange(1, 15))] for k in range(60)}
    rows = [(k, i, w, float(i % 5)) for k, own in posts.items() for i, w in enumerate(own)]
    got: dict = {}
    for r in tokens.merge_tokens(frame(spark, rows, "post_id string, pos long, token string, score double")).orderBy("post_id", "start").collect():
        got.setdefault(r["post_id"], []).append((r["start"], r["text"], r["score"]))
    for k, own in posts.items():
        out = []
        for i, w in enumerate(own):
            piece = (w[1:] or " ") if w.startswith("▁") else w[2:] if w.startswith("##") else w
            if not piece.strip():
                continue
            glued = w.startswith("##") or not piece.strip("!.,;:?؟،٪٫…")
            if glued and out:
                out[-1] = (out[-1][0], out[-1][1] + piece, max(out[-1][2], float(i % 5)))
            else:
                out.append((i, piece, float(i % 5)))
        assert got.get(k, []) == out


def test_a_long_rollout(spark):
    """Twelve layers of 197 tokens: one exchange, no row per product."""
    n, layers = 197, 12
    cells = spark.range(layers * n * n).select(
        F.lit("p").alias("post_id"),
        F.floor(F.col("id") / (n * n)).cast("int").alias("layer"),
        F.lit(0).alias("head"),
        F.floor(F.col("id") % (n * n) / n).cast("int").alias("i"),
        (F.col("id") % n).cast("int").alias("j"),
        ((F.col("id") * 37 % 101) / 101.0).alias("w"),
    )
    out = attention.rollout(cells, layers, residual=True)
    assert exchanges(out) == 1
    got = np.zeros((n, n))
    for r in out.collect():
        got[r["i"], r["j"]] = r["w"]
    raw = (np.arange(layers * n * n) * 37 % 101 / 101.0).reshape(layers, n, n)
    want = np.eye(n)
    for m in raw:
        m = m + np.eye(n)
        want = (m / m.sum(1, keepdims=True)) @ want
    assert np.allclose(got, want)


@pytest.mark.parametrize("part_rows", [4, 64, 4096])
def test_label_pairs_against_rows_per_post(spark, part_rows, monkeypatch):
    monkeypatch.setattr(annotation, "AT_ONCE", 50)
    rng = random.Random(part_rows)
    rows = {(f"u{rng.randrange(25)}", f"p{rng.randrange(12)}") for _ in range(220)} | {(f"u{k}", "hot") for k in range(25)}
    latest = frame(spark, [(a, p, rng.choice(K.LABELS)) for a, p in sorted(rows)], "annotator_id string, post_id string, label string")
    got = sorted(map(tuple, annotation.label_pairs(latest, part_rows).collect()))
    keys = ["annotator_a", "annotator_b", "label_a", "label_b"]
    want = annotation.annotator_pairs(latest).groupBy(*keys).agg(F.count("*").alias("n"))
    assert got == sorted(map(tuple, want.select(*keys, "n").collect()))
    assert annotation.label_pairs(latest.limit(0), part_rows).collect() == []


def test_the_agreement_report_is_a_file(spark, tmp_path):
    rows = [("p", "positive", "b", 1), ("p", "positive", "a", 2), ("q", "negative", "a", 3), ("q", "neutral", "b", 4), ("q", "negative", None, 5)]
    log = frame(spark, rows, "post_id string, label string, annotator_id string, ord long")
    annotation.write_agreement_report(log, str(tmp_path / "report"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert text == [
        "# Inter-Annotator Agreement",
        "",
        "## Per-pair Cohen's kappa",
        "",
        "| Annotator A | Annotator B | Overlap | Kappa |",
        "| --- | --- | --- | --- |",
        "| _unknown_ | a | 1 | 0.0000 |",
        "| _unknown_ | b | 1 | 0.0000 |",
        "| a | b | 2 | 0.3333 |",
        "",
        "## Per-annotator counts",
        "",
        "| Annotator | Labeled posts |",
        "| --- | --- |",
        "| _unknown_ | 1 |",
        "| a | 2 |",
        "| b | 2 |",
    ]
    annotation.write_agreement_report(log.filter("annotator_id = 'a'"), str(tmp_path / "alone"))
    assert K.REPORT_NO_PAIRS in [r["value"] for r in spark.read.text(str(tmp_path / "alone")).collect()]


def test_terms_are_found_by_their_rarest_gram(spark):
    rng = random.Random(4)
    tags = sorted({"".join(rng.choice("abcAB") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(40)})
    specs = frame(spark, [(k, t, True) for k, t in enumerate(terms)], "ord long, term string, search boolean")
    catalogue = frame(spark, list(enumerate(tags)), "ord long, tag string")
    out = curate.expand_terms(specs, catalogue)
    want, seen = [], set()
    for k, term in enumerate(terms):
        for tag in [t for t in tags if term in t.lower()] or [term]:
            if tag.lower() not in seen:
                seen.add(tag.lower())
                want.append((k, tag))
    assert sorted((r["ord"], r["tag"]) for r in out.collect()) == sorted(want)


@pytest.mark.parametrize("rules", [gates.FEED, gates.LOCAL, gates.GateRules(require_caption=True, spam_blocks=True, sarcasm_only=True)])
def test_verdicts_fold_a_caption_once(spark, rules):
    posts = frame(spark, [("a", 1, "سلام دنیا PROMPT", True), ("b", 2, "", True), ("c", 3, "Hello", True), ("d", 4, "ولی خوشحال «دنیا»", True)], "post_id string, ord long, caption string, media_ok boolean")
    judged = gates.verdicts(posts, rules, media_ok=F.col("media_ok"))
    assert judged.columns == [*posts.columns, "reason"]
    got = {r.post_id: r.reason for r in judged.collect()}
    assert got == {"a": "spam", "b": "accepted" if rules.allow_blank else "no_caption" if rules.require_caption else "wrong_script", "c": "wrong_script", "d": "accepted"}
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 + rules.sarcasm_only


def test_pairs_come_in_ranges_in_order(spark, monkeypatch):
    """Several ranges, posts cut into parts, names that do not sort by length, nulls that meet nobody: counted as row by row, in order."""
    monkeypatch.setattr(annotation, "AT_ONCE", 300)
    rng = random.Random(8)
    names = [f"u{k}" for k in range(30)] + ["_unknown_", "é", "z\U0001f600", "z￮"]
    rows = {(a, f"p{rng.randrange(60)}") for a in names for _ in range(12)} | {(a, "hot") for a in names}
    rows = [(a, p, rng.choice(K.LABELS)) for a, p in sorted(rows)] + [("u1", None, "neutral"), ("u2", None, "neutral"), (None, "hot", "neutral")]
    latest = frame(spark, rows, "annotator_id string, post_id string, label string").repartition(5).cache()
    found = annotation.label_pairs(latest, part_rows=16, range_pairs=200)
    got = [tuple(r) for r in found.collect()]
    keys = ["annotator_a", "annotator_b", "label_a", "label_b"]
    want = annotation.annotator_pairs(latest).groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, "n")
    assert sorted(got) == sorted(map(tuple, want.collect()))
    assert [r[:2] for r in got] == sorted(r[:2] for r in got)
    assert found.rdd.getNumPartitions() > 3
    whole = annotation.cohens_kappa(annotation.label_pairs(latest, part_rows=16, range_pairs=200, by_pair=True))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, annotation.cohens_kappa(want).collect()))


def test_no_exchange_has_a_row_per_pair(spark):
    """Posts and packed ranges are exchanged; sums, kappas and lines stay where the ranges are."""
    latest = frame(spark, [(f"u{a}", f"p{p}", K.LABELS[(a + p) % 5]) for a in range(40) for p in range(50)], "annotator_id string, post_id string, label string")
    pairs = annotation.label_pairs(latest, range_pairs=5000)
    kappas = annotation.cohens_kappa(annotation.label_pairs(latest, range_pairs=5000, by_pair=True))
    for df in (pairs, kappas):
        dealt = re.findall(r"\bExchange (\S+)\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())
        assert len(dealt) == 2 and not any("annotator_" in columns for _, columns in dealt)
    blocks = list(annotation._pack_pairs([("u20", "u21")], 10_000)(iter(latest.selectExpr("*", "0 AS _own", "0 AS _first", "0 AS _second").orderBy("post_id").toArrow().to_batches())))
    assert sum(b.num_rows for b in blocks) < 20  # of 39,000 meetings
    assert sum(len(x) for b in blocks for x in b.column("_packed").to_pylist()) < 4 * 39_000


def test_a_long_agreement_report_is_written_in_order(spark, tmp_path):
    """Pairs in several ranges: several files, which together are the one sorted file."""
    rng = random.Random(3)
    rows = [(f"p{k // 7}", rng.choice(K.LABELS), f"u{rng.randrange(40)}" if k % 9 else None, k) for k in range(1500)]
    log = frame(spark, rows, "post_id string, label string, annotator_id string, ord long")
    for name, size in (("one", 10**9), ("many", 300)):
        annotation.write_agreement_report(log, str(tmp_path / name), range_pairs=size)
    files = {name: sorted((tmp_path / name).glob("part-*")) for name in ("one", "many")}
    assert len(files["one"]) == 1 and len(files["many"]) > 5
    one, many = ("".join(f.read_text() for f in files[name]) for name in ("one", "many"))
    assert one == many and one.count("\n") > 500
    assert [r["value"] + "\n" for r in lines.numbered_lines(spark, str(tmp_path / "many")).orderBy("ord").collect()] == one.splitlines(True)


def test_numbering_lines_exchanges_no_line(spark, tmp_path):
    """Also where the runtime would not broadcast a table of that size."""
    spark.range(1000).select(F.col("id").cast("string")).repartition(4).write.text(str(tmp_path / "text"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = lines.numbered_lines(spark, str(tmp_path / "text"))
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(r["ord"] for r in numbered.collect()) == list(range(1, 1001))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
