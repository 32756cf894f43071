import math
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import residue_cases  # noqa: E402

from spanforge.llm import neighbors, residue  # noqa: E402


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def brute(rows, k, least, dim):
    seen = {}
    for i, g, v in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v):
            seen[i] = (g or "", np.array(v))
    out = set()
    for i, (g, v) in seen.items():
        near = sorted((-round(cosine(v, w), 9), j) for j, (h, w) in seen.items() if j != i and h == g and cosine(v, w) >= least - 1e-9)[:k]
        out |= {(min(i, j), max(i, j)) for _, j in near}
    return out


def rows_for(seed, n, copies, dim=8):
    rng = np.random.default_rng(seed)
    f32 = lambda v: [float(x) for x in np.float32(v)]
    rows = []
    centres = rng.standard_normal((12, dim))
    for i in range(n):
        v = centres[i % 12] + 0.25 * rng.standard_normal(dim)
        rows.append((i, "m" if i % 3 else "n", f32(v * rng.uniform(0.5, 2))))
    hot = f32(rng.standard_normal(dim))
    rows += [(10_000 + i, "m", hot) for i in range(copies)]
    rows += [(20_000, "m", None), (20_001, "m", [1.0] * 3), (20_002, "m", [0.0] * dim), (20_003, "m", [float("nan")] * dim), (None, "m", hot), (20_004, None, hot), (20_005, None, hot), rows[0], rows[1]]
    return rows


def pairs(df):
    return {(min(r["vec"], r["other"]), max(r["vec"], r["other"])) for r in df.collect()}


@pytest.mark.parametrize("copies,leaf_rows", [(3, 4096), (40, 4096), (40, 16)])
def test_neighbours(spark, copies, leaf_rows):
    rows = rows_for(copies, 400, copies)
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id bigint, model string, embedding array<float>, sim double").repartition(3)
    got = neighbors.similar_pairs(df, dim=8, k=5, least=0.9, sample=(64, 512), leaf_target=32, leaf_rows=leaf_rows)
    want = brute(rows, 5, 0.9, 8)
    found = pairs(got)
    assert len(want & found) >= 0.95 * len(want) and len(found - want) <= 0.05 * len(want)
    hot = {p for p in want if p[0] >= 10_000}
    assert {p for p in found if p[0] >= 10_000} == hot  # copies are exact whatever their number
    per = defaultdict(list)
    for r in got.collect():
        per[r["vec"]].append(r["rank"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 5 for x in per.values())


def test_neighbours_of_few_vectors(spark):
    schema = "vec_id bigint, model string, embedding array<float>"
    assert neighbors.similar_pairs(spark.createDataFrame([], schema), dim=2).count() == 0
    assert neighbors.similar_pairs(spark.createDataFrame([(1, "m", [1.0, 0.0])], schema), dim=2).count() == 0
    two = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", [2.0, 0.1]), (3, "n", [1.0, 0.0])], schema)
    assert pairs(neighbors.similar_pairs(two, dim=2)) == {(1, 2)}


def test_repeated_rows_take_one_place_among_the_copies(spark):
    hot, twice = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, "m", hot)] * 10 + [(2, "m", hot), (3, "m", hot)] + [(i, "m", twice) for i in range(11, 16) for _ in range(2)]
    df = spark.createDataFrame(rows, "vec_id bigint, model string, embedding array<float>").coalesce(1)
    want = {(1, 2), (1, 3), (2, 3)} | {(a, b) for a in range(11, 16) for b in range(a + 1, 16)}
    assert pairs(neighbors.similar_pairs(df, dim=2)) == want


def test_recall_report(spark):
    rows = rows_for(5, 300, 0)
    df = spark.createDataFrame(rows, "vec_id bigint, model string, embedding array<float>")
    found = neighbors.similar_pairs(df, dim=8, k=5, least=0.9, sample=(64, 512), leaf_target=32)
    for block in (16_384, 7):
        report = {r["model"]: r for r in neighbors.recall_report(df, found, dim=8, least=0.9, every=3, block=block).collect()}
        assert report["n"]["mean_recall"] >= 0.95 and report["n"]["n"] > 50
    empty = {r["model"]: r["mean_recall"] for r in neighbors.recall_report(df, found.limit(0), dim=8, least=0.9, every=3).collect()}
    assert set(empty.values()) == {0.0}


def test_tree_visits_in_order_and_reaches_all():
    x = np.random.default_rng(2).standard_normal((500, 6))
    tree = neighbors.fit_tree(x, 30)
    leaves = set(np.flatnonzero(tree.count == 0).tolist())
    home = tree.home(x)
    assert set(home.tolist()) <= leaves and len(leaves) >= 20
    rows, visited, bounds = tree.visits(x[:20], 0.3)
    for i in range(20):
        b = bounds[rows == i]
        assert (np.diff(b) >= 0).all() and b[0] == 0 and visited[rows == i][0] == home[i]
        assert np.allclose(tree.leaf_bound(np.repeat(x[i : i + 1], len(b), axis=0), visited[rows == i]), b)
    rows, visited, _ = tree.visits(x[:5], 1e9)
    assert all(set(visited[rows == i].tolist()) == leaves for i in range(5))
    stop = np.linspace(0, 0.5, 20)
    rows, _, bounds = tree.visits(x[:20], stop)
    assert (bounds <= stop[rows]).all()


def test_no_vector_of_a_bin_is_nearer_than_its_bound():
    x = np.random.default_rng(3).standard_normal((400, 5))
    tree = neighbors.fit_tree(x, 25)
    home = tree.home(x)
    for i in range(0, 400, 40):
        bound = tree.leaf_bound(np.repeat(x[i : i + 1], len(x), axis=0), home)
        assert (bound <= np.sqrt(((x - x[i]) ** 2).sum(axis=1)) + 1e-4).all()


def test_leaves_are_replaced_by_subtrees():
    x = np.random.default_rng(4).standard_normal((600, 4))
    tree = neighbors.fit_tree(x, 8)
    home = tree.home(x)
    leaf = int(np.bincount(home).argmax())
    grown = tree.grown({leaf: neighbors.fit_tree(x[home == leaf], 6)})
    again = grown.home(x)
    assert (again[home != leaf] == home[home != leaf]).all() and grown.count[leaf] > 0
    assert len(set(again[home == leaf].tolist())) > 2 and (grown.count[again] == 0).all()


def test_width_is_widened_until_both_halves_are_found():
    q, sim = np.array([0, 0, 1, 2, 3]), np.array([0.99, 0.95, 0.96, 0.97, 0.93])
    near = np.array([0.0, 0.1, 0.3, 0.0, 0.05])
    width = neighbors.width_for(q, sim, near, near, 2, 0.92, 1.0)
    stop = neighbors._distance(0.92)
    assert width >= neighbors.MARGIN * 0.3 / max(stop, neighbors._distance(0.96)) and neighbors.width_for(q[:0], sim[:0], near[:0], near[:0], 2, 0.92, 1.0) > 0


def test_cells_of_crowded_blocks():
    rng = np.random.default_rng(7)
    sim = rng.uniform(0.9, 1.0, (90, 70)).astype(np.float32)
    a, b = neighbors.best_cells(sim, 3, 0.9)
    want = {(i, j) for i in range(90) for j in np.argsort(-sim[i])[:3].tolist()} | {(i, j) for j in range(70) for i in np.argsort(-sim[:, j])[:3].tolist()}
    assert want <= set(zip(a.tolist(), b.tolist())) and len(a) < 90 * 70 / 4
    a, b = neighbors.best_cells(sim, 3, 0.9999)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in zip(*np.nonzero(sim >= np.float32(0.9999)))}


def test_large_leaves_are_split_on_samples_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 8))
    rows = [(i, "m", [float(z) for z in np.float32(centres[i % 40] + 0.05 * rng.standard_normal(8))]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id bigint, model string, embedding array<float>").repartition(3)
    vectors = neighbors.usable_vectors(df, "vec_id", "embedding", "model", 8)
    tree, sizes = neighbors.grow_tree(vectors, 1600, 8, 7, (32, 32), 40)
    assert (tree.count == 0).sum() > 10 and max(sizes.values()) <= 160
    want = brute(rows, 5, 0.98, 8)
    found = pairs(neighbors.similar_pairs(df, dim=8, k=5, least=0.98, sample=(32, 32), leaf_target=40, leaf_rows=64))
    assert len(want & found) >= 0.97 * len(want)


FOUND = [
    "Hello {{ user_name }}, welcome back.", "The {% block body %}{% endblock %} goes on.", "Pay ${price} now", "Dear $(name),", "See [[title]] for more", "By <%= owner %> today", "%%TITLE%%", "@@summary@@ follows",
    "From __OWNER__ with care", "Contact: <COMPANY>", "Owner - [INSERT NAME HERE]", "[price goes here]", "Scope {0}", "About «title» today",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "asdf qwer foo bar asdf bla", "Your summary goes here.", "TODO: write the section.", "Replace this sample paragraph with your own.",
    "This is a placeholder section; write something.", "Summary to be supplied.", "Heading 2: coming soon", "Caption 3: n/a yet", "Item 4: ...", "Texte à remplacer.", "Escriba aquí su texto.", "Escriba aquí su texto.Escriba aquí su texto.", "Hier steht später der Text.", "此处填写内容。", "ここに本文を入力してください。",
    "404 Not Found", "Error 503: service unavailable. Reference a1b2", "The page you asked for could not be found. Return to the start page.", "Oops! that did not work while loading this page. (ab12)", "Access denied. Ray: 77", "Your session has expired. Sign in to continue.",
    "Checking your browser. Complete the check to go on.", "Rate limit reached. Try again later.", 'Traceback (most recent call last):\n  File "/srv/x/view.py", line 3, in render\nKeyError: \'a\'', "Page introuvable. Vérifiez l'adresse.", "Página no encontrada.", "Zugriff verweigert.",
    "页面不存在或已被删除 12", "ページが見つかりません", "Good text first.\n\nMenu\nSkip to content\nPlease enable scripts to view this page.", "<noscript>Scripts required.</noscript>", "You need to enable JS to run this app.", "This viewer does not work without client-side scripts.",
    "Your browser is too old; upgrade it to see the content.", "Veuillez activer JavaScript pour continuer.", "Bitte aktivieren Sie JavaScript.", "请启用 JavaScript 后继续", "JavaScriptを有効にしてください",
]
CLEAN = [
    None, "", " \n\t", "An ordinary sentence about kilns.", "We dropped 522 pages that only said “404 Not Found” from the crawl.", "Placeholders like `[price goes here]` are documented in the guide, chapter 7.", 'Some code:\n```\ntpl = "{{ query }}"\nprint(tpl, 3)\n```\nand prose.',
    "Lorem ipsum is no longer used as filler in Pagefi; the 12 mock texts were rewritten by hand.", "The HTML report works without JavaScript, so nobody has to enable it.", "An internal server error in run 468 came from a full disk, as the log explains.",
    "If the service is unavailable, Kiln retries 3 times and then returns a cached answer.", "Access was denied to 759 of the testers until the gateway rule changed.", "The metric is {hits: 10, misses: 5}, written as a plain JSON object.", "A set such as {612, 613} in brackets [612] marks the spans.",
    "<|endoftext|>", "<pad><unk>", "<s></s>", "[copy 68] In a text", '{"a":{"k":1,"v":["x","y"]}}', "de5188cee091c3e957bbc337ec2fccf2755d", "topeki_quzovu_gigike __init__ x", "In Fiyube the renderer replaces `__PRICE__` with the value of the field before indexing.", "[MASK] <PAD> [CLS]", "## Absatz Index 404",
]


def test_residue(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(FOUND + CLEAN)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, leaf string, doc string").repartition(2)
    got = {r["doc"]: r["reason"] for r in residue.find_residue(df).collect()}
    missed = [FOUND[i] for i in range(len(FOUND)) if i not in got]
    wrong = [CLEAN[i - len(FOUND)] for i in got if i >= len(FOUND)]
    assert not missed and not wrong
    kept = residue.exclude_residue(df)
    assert kept.columns == df.columns and kept.count() == len(CLEAN)


def test_held_out_residue():
    cases = residue_cases.cases()
    found = [(y, residue.reason_of(t) is not None) for t, y in cases]
    true = sum(y and f for y, f in found)
    assert true >= 0.95 * sum(y for y, _ in found) and true >= 0.97 * sum(f for _, f in found)


def test_one_template_for_messages_that_differ_in_other_words(spark):
    rows = [(i, f"Error {500 + i % 4}: internal server error. Request id {i}{i}") for i in range(9)] + [(99, "Turn on JavaScript to view this page."), (98, "Turn on JavaScript to open this kiln.")]
    got = {r["template"]: (r["messages"], r["verdict"]) for r in residue.mine_templates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got["error <status> : internal server error"] == (9, "failed page")
    assert [v for t, v in got.items() if t.startswith("turn on javascript")] == [(1, "script notice"), (1, "script notice")]


def test_a_tree_begun_anew_gives_the_same_verdicts():
    texts = FOUND + [t for t in CLEAN if t]
    small, large = residue.Tree(most=2), residue.Tree()
    assert [residue.reason_of(t, small) for t in texts] == [residue.reason_of(t, large) for t in texts]
    assert small.size <= 2 < large.size


def test_every_rule_needs_an_anchor():
    for reason, rule, needed in residue._RULES:
        phrases = min(needed, key=lambda e: sum(residue.ANCHORS.isdisjoint(p.replace("’", "'").split("_")) for p in e))
        assert all(p == "{STATUS}" or not residue.ANCHORS.isdisjoint(p.replace("’", "'").split("_")) for p in phrases), (rule.pattern[:80], phrases)


PROBES = [
    ("The page you requested could not be found", "The page you requested is very interesting indeed"), ("You do not have permission to see this page", "You do not have permission slips for this trip"),
    ("Your browser does not support this video", "Your cousin does not support this video"), ("You need to enable JavaScript to run this app.", "You need to enable heating to run this kiln."),
    ("The page you asked for could not be found.", "The page you asked for has two long columns."),
]


@pytest.mark.parametrize("parts", [1, 3])
def test_verdicts_do_not_depend_on_the_other_messages_of_a_leaf(spark, parts):
    texts = [t for pair in PROBES for t in pair]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(parts)
    assert {r["doc"] for r in residue.find_residue(df).collect() if r["doc"] % 2 == 0} == set(range(0, len(texts), 2))
    assert {r["doc"] for r in residue.find_residue(df).collect()} <= set(range(0, len(texts), 2)) | {3}


@pytest.mark.parametrize("text", ["This page is unavailable until the maintenance window ends.", "This page is no longer available until the move is over.", "An unexpected error occurred, so nobody could be signed in."])
def test_wordings_of_reports_do_not_hide_a_failed_page(text):
    assert residue.classify(text) == "failed page"


@pytest.mark.parametrize("text,want", [
    ("Traceback (most recent call last): " + "File x.py, line 3, in run, " * 12 + "KeyError", "failed page"), ("com.x.StateException: " + "the store of the kiln is not ready and " * 8, "failed page"),
    ("抱歉" + "这是很长的一段通知" * 30 + "页面不存在", "failed page"), ("A plain sentence about kilns, " * 12, None), ("Not found " + "in the long list of the kilns, " * 12, None),
])
def test_long_messages(text, want):
    assert len(text) > 240 and residue.classify(text) == want


def test_residue_of_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert residue.find_residue(df).count() == 0 and residue.exclude_residue(df).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "404 Not Found"), (1, "404 Not Found"), (None, "404 Not Found"), (None, "fine")], "doc_id bigint, text string")
    assert residue.find_residue(df).count() == 3 and residue.exclude_residue(df).count() == 2
