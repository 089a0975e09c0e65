from __future__ import annotations

import random

from evenkeel.llm import decontaminate, html_blocks, html_training


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


PROSE = "Some sentences stand here, with words. They go on for a while, and then they end. "


def test_article_without_boilerplate():
    html = page(
        '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy this now, it is good.</div>'
        f"<article><h1>A title &amp; more</h1><p><b>Lead.<br><p>{PROSE}\n  x&nbsp;y</p><p>{PROSE}<p>Last one.</article>"
        f'<div class="comments"><h3>Comments</h3><p>{PROSE}</p></div><footer>&copy; example &middot; Words here.</footer>'
    )
    prose = PROSE.strip()
    assert html_blocks.main_texts([html])[0] == "\n\n".join(["A title & more", "Lead.", f"{prose} x y", prose, "Last one."])


def test_blocks_of_malformed_pages():
    texts = lambda h: [b.text for b in html_blocks.blocks(h)]
    assert texts("") == [] and texts("plain  text") == ["plain text"]
    assert texts("<p>a<p>b</p>c<div>d<br>e</div><ul><li>f<li>g</ul>") == ["a", "b", "c", "d e", "f", "g"]
    assert texts("<p>x</b></div> y<script>if (a<b) '</p>'</script> z") == ["x y z"]
    assert texts("a < b &lt; c &#233; &nope; <unknown>d") == ["a < b < c é &nope;", "d"]
    assert texts("<p>open <!-- never closed") == ["open"]
    assert texts('<p title="a > b">t</p><form><label>l</label><select><option>no</select><textarea>no</textarea></form>') == ["t", "l"]


def test_blocks_go_on_where_end_tags_are_missing():
    texts = lambda h: [b.text for b in html_blocks.blocks(h)]
    assert texts("<head><title>t</title><meta a=b><body><p>x</p>") == ["x"]
    assert texts("<head><title>t</title><p>x</p>") == ["x"] and texts("<head> words<p>x</p>") == ["words", "x"]
    assert texts("<head><script>for(i=0;i<n;i++){ // don't\n}</script></head><body><p>it's here</p>") == ["it's here"]
    assert texts("<datalist><option value=a><option value=b></datalist><p>x</p>") == ["x"]
    assert texts("<select><option>a<option>b</select><p>x</p>") == ["x"] and texts("<select><option>a<p>x</p>") == ["x"]
    for name in ("button", "object", "svg", "select", "audio", "iframe", "textarea", "noscript", "title", "template"):
        assert texts(f"<div><{name}></div><p>x</p><p>y") == ["x", "y"], name
    assert texts("<div>a <select><option>b</div><p>x</p><select></select>") == ["a", "x"]


def test_blocks_hold_what_stands_among_words():
    texts = lambda h: [b.text for b in html_blocks.blocks(h)]
    assert texts("<p>Energy is <math><mi>E</mi><mo>=</mo><msup><mi>m</mi></msup></math> always</p>") == ["Energy is E=m always"]
    assert texts("<p>a <svg><g><title>no</title><text>no</text></g></svg> b <img src=x> c <input value=y> d</p>") == ["a b c d"]
    assert texts("<p>Press <button>OK</button> now</p><div><button>Menu</button></div>") == ["Press OK now"]
    assert texts("<p>a<script>x</script>b<style>y</style>c</p><map><area><p>in a map</p></map>") == ["abc", "in a map"]
    assert texts("<p>a<hr>b") == ["a", "b"]


def test_tags_with_stray_quotes():
    texts = lambda h: [b.text for b in html_blocks.blocks(h)]
    assert texts('<p class="x>Body</p><p class="y">more</p>') == ["more"]
    assert texts("<p title=it's>a</p><p don't>b</p><a href=x?y='z>c</a>") == ["a", "b", "c"]
    assert texts("<p>a</p><p title='never closed>b</p>") == ["a"]
    assert texts('<p title = "a > b" class=c>t</p></ nothing>u<!-->v<!-- x --!>w') == ["t", "uvw"]


def test_labels_of_unseen_made_up_pages():
    wrong = blocks = 0
    for seed in range(150):
        x, y = html_training.example(seed)
        if len(x):
            p = html_blocks.labeller().probabilities([x])[0]
            wrong += int(((p >= 0.5) != (y >= 0.5)).sum())
            blocks += len(y)
    assert wrong / blocks < 0.04


def test_batches_do_not_change_labels():
    pages = [html_training.example(s)[0] for s in range(40)]
    many = html_blocks.labeller().probabilities(pages)
    for p, found in zip(pages, many, strict=True):
        assert abs(html_blocks.labeller().probabilities([p])[0] - found).max(initial=0) < 1e-5


def test_extraction_over_rows(spark):
    rows = [(1, "u", page(f"<article><p>{PROSE}</p></article>"), "t"), (2, None, None, "t"), (3, "u", "", "t"), (3, "u", "", "t"), (4, "u", page(f"<article>{'<p>' + PROSE + '</p>'}" * 3000), "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_blocks.extract(df).collect()
    assert sorted((r["page_id"], r["text"]) for r in found)[:3] == [(1, PROSE.strip()), (2, ""), (3, "")]
    assert all(r["n_chars"] == len(r["text"]) for r in found) and len(found) == 5
    assert html_blocks.extract(df.where("false")).count() == 0


def brute(docs: list, items: list) -> dict:
    """All diagonals, without seeds, with the hits that a seed needs."""
    plain = lambda t: ["".join(c for c in w if c.isalnum()) for w in (t or "").lower().split()]
    out: dict = {}
    for i, t in docs:
        d = [w for w in plain(t) if w]
        for j, u in items:
            b = [w for w in plain(u) if w]
            if min(len(d), len(b)) < decontaminate.SPAN:
                continue
            for g in range(-len(b) + 1, len(d)):
                e = [0 <= k + g < len(d) and d[k + g] == b[k] for k in range(len(b))]
                spans = [k for k in range(len(b) - decontaminate.SPAN + 1) if 0 <= k + g <= len(d) - decontaminate.SPAN]
                if not any(all(e[k + o] for o, on in enumerate(m) if on == "1") for k in spans for m in decontaminate.MASKS):
                    continue
                width = min(decontaminate.WINDOW, len(b))
                best = max(sum(e[s : s + width]) for s in range(len(b) - width + 1))
                if best >= decontaminate.SHARE * width:
                    n, w, _ = out.get((i, j), (0, 0, 0))
                    out[i, j] = max(n, sum(e)), max(w, best), len(b)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(40)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(j, say(rng.randint(4, 40))) for j in range(12)]
    docs = []
    for i in range(60):
        text = say(rng.randint(0, 80))
        if i % 3 == 0:
            passage = list(items[i % 12][1])
            for _ in range(rng.randint(0, 4)):
                passage[rng.randrange(len(passage))] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = passage[rng.randint(0, 3) :]
        docs.append((i, " ".join(w.upper() if rng.random() < 0.1 else w + rng.choice(["", ",", "."]) for w in text)))
    docs += [(97, None), (98, ""), (99, " ".join(items[5][1]) + " x" * 20_000), (3, docs[3][1])]
    items = [(j, " ".join(w)) for j, w in items] + [(50, None), (51, "too short")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 12
    for limit in (decontaminate.BROADCAST_WORDS, 0):
        decontaminate.BROADCAST_WORDS, held = limit, decontaminate.BROADCAST_WORDS
        try:
            found = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["best_window"], r["item_words"]) for r in decontaminate.leaks(d, b).collect()}
        finally:
            decontaminate.BROADCAST_WORDS = held
        assert found == want
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.leaks(d.where("false"), b).count() == 0 and decontaminate.leaks(d, b.where("false")).count() == 0


def test_short_items_equal_brute_force_without_seeds(spark):
    """Every substitution of up to two words in items of 10 to 14 words; shorter items whole, also at a document's ends."""
    from itertools import combinations

    items = [(n, [f"w{n}_{i}" for i in range(n)]) for n in (1, 3, 5, 9, 10, 11, 12, 13, 14)]
    docs = [(0, ["x", "y"]), (1, [])]
    for _, item in items:
        docs += [(len(docs), item), (len(docs) + 1, ["x", *item, "y"])]
        for k in (1, 2, 3):
            for at in combinations(range(len(item)), min(k, len(item))):
                docs.append((len(docs), [w for w in (["z"] if at[0] % 2 else []) + ["other" if i in at else w for i, w in enumerate(item)]]))
        docs += [(len(docs), item[1:]), (len(docs) + 1, item[:-2])]
    want = set()
    for i, d in docs:
        for j, b in items:
            width = min(decontaminate.WINDOW, len(b))
            need = len(b) if len(b) < decontaminate.SPAN else decontaminate.SHARE * width
            for g in range(-len(b) + 1, len(d)):
                e = [0 <= k + g < len(d) and d[k + g] == b[k] for k in range(len(b))]
                if max(sum(e[s : s + width]) for s in range(len(b) - width + 1)) >= need:
                    want.add((i, j))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(j, " ".join(w)) for j, w in items], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_WORDS, 0):
        decontaminate.BROADCAST_WORDS, held = limit, decontaminate.BROADCAST_WORDS
        try:
            assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b, short_items=True).collect()} == want
        finally:
            decontaminate.BROADCAST_WORDS = held
    missed = want - {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()}
    print(f"{len(want)} pairs, without short items {len(missed)} missed")


def test_ids_that_are_null_or_repeated(spark, monkeypatch):
    """Both ways of joining give the same: items without an id are found, rows of one id don't lend each other words."""
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(None, say(20)), (1, say(20)), (1, say(25)), (2, "four short words here"), (3, None), (1, None)]
    docs = [(None, f"{say(30)} {items[0][1]}"), (7, f"{say(5)} {items[1][1]} {say(9)}"), (7, say(40)), (7, items[2][1]), (8, f"x {items[3][1]} y"), (9, say(50)), (8, None)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for most in (10**6, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", most)
        found = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["item_words"]) for r in decontaminate.leaks(d, b, short_items=True).collect()}
        assert found == {(None, None): (20, 20), (7, 1): (25, 25), (8, 2): (4, 4)}
        kept = decontaminate.clean(d.select("doc_id", "text"), b, short_items=True)
        assert [r["doc_id"] for r in kept.collect()] == [9]
