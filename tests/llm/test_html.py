import numpy as np
import pytest

from llm import html as h
from llm.layouts import MARK, restyled

LINE = "Thing erin of the other and, by then, it was here. More of it came."


@pytest.fixture(scope="module")
def labeller(spark):
    folder = "/root/testdata/sf0.01"
    return h.fit(spark.read.parquet(f"{folder}/pages.parquet"), layouts=1500)


def test_blocks_decode_and_survive_broken_markup():
    page = ("<!DOCTYPE html><title>no</title><style>p{}</style><script>var a='</p>'</script><!-- <p>no</p> --><div id=x>a &amp; b&nbsp;&copy;<br>c"
            "<p>one <b>two\n\n three<p>four</div><ul><li>x<li>y</ul>5 < 6<p class='q")
    assert [b.text for b in h.blocks(page)] == ["a & b ©  c".replace("  ", " "), "one two three", "four", "x", "y", "5 < 6"]
    assert h.blocks("<p>a &am")[0].text == "a &am" and h.blocks("<script>x") == h.blocks(None) == h.blocks("") == []
    nested = h.blocks('<div class="postBody ads-top"><p>t</p></div>')[0].path
    assert {"<div", ".post", ".body", ".ads", ".top", "<p"} <= set(nested)


def test_gradient():
    net = h.Labeller()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    found = [h.Block("Some text, here.", ["<div", ".a", "<p"]), h.Block("menu", ["<nav"]), h.Block("more text", ["<div", "<p"], 4)]
    bags = net.inputs(found)
    place, labels = np.array([[0, 2], [1, -1]]), np.array([1.0, 0.0, 1.0])
    grad, _ = net.gradient(bags, place, labels)
    for name, g in grad.items():
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for step in (1e-3, -1e-3):
            net.p[name][k] += step
            losses.append(net.gradient(bags, place, labels)[1])
            net.p[name][k] -= step
        assert abs((losses[0] - losses[1]) / 2e-3 - g[k]) < 1e-2 * max(1e-2, abs(g[k])), name


def test_held_out_layouts(labeller):
    rng = np.random.default_rng(123)
    wrong = total = 0
    for _ in range(150):
        page, mark = restyled(rng, [LINE + f" {k}." for k in range(int(rng.integers(2, 9)))], [LINE, "Home", "Buy it now", "A line of a menu"])
        found = h.blocks(page)
        want = [b.text.endswith(MARK) for b in found]
        for b in found:
            b.text = b.text.replace(mark, "").strip()
        wrong += int(((labeller.probabilities([found])[0] >= 0.5) != np.array(want)).sum())
        total += len(found)
    assert wrong / total < 0.05


def test_articles_of_the_tables_and_odd_rows(spark, labeller):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    for r in pages.join(h.extract(pages, labeller), "page_id").collect():
        found = h.blocks(r.html)
        assert r.text == "\n".join(b.text for b, y in zip(found, h.taught(found)) if y) and r.n_chars == len(r.text)
    page = f"<nav><a>Home</a></nav><article>{''.join(f'<p>{LINE}</p>' for _ in range(3000))}</article><footer>&copy; me</footer>"
    rows = [(1, None, "t", "c"), (2, "", "t", "c"), (3, page, "t", "c"), (3, page, "t", "c"), (None, "<b>", "t", "c"), (4, "<nav>Home</nav>", "t", "c")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars string"), labeller).collect()
    assert len(got) == 6 and {r.page_id: r.n_chars for r in got} == {1: 0, 2: 0, 3: 3000 * (len(LINE) + 1) - 1, None: 0, 4: 0}
    assert h.extract(pages.limit(0), labeller).count() == 0


def test_no_page_to_learn_from(spark):
    empty = spark.createDataFrame([], "page_id long, html string")
    net = h.fit(empty, layouts=600)
    assert h.main_text(net, [f"<nav>Home</nav><article><p>{LINE}</p></article>"]) == [LINE]


def test_open_tags_take_linear_room_and_time():
    import time
    import tracemalloc

    net = h.Labeller()
    for page in ('<div class="wrap main content">x' * 50_000, "<b>x<div>y</div>" * 50_000, "<div>x" * 25_000 + "</span></li></div>" * 25_000):
        tracemalloc.start()
        start = time.process_time()
        text = h.main_text(net, [page])[0]
        taken, most = time.process_time() - start, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 500e6 and taken < 120 and set(text) <= set("xy\n")


def test_whole_attribute_values_and_blocks_are_read():
    late = " ".join(f"u-{chr(97 + k % 26)}{k}" for k in range(300)) + " sidebar"
    assert ".sidebar" in h.blocks(f'<div class="{late}">x</div>')[0].path
    plain = h.numbers(h.blocks("<p>" + "word " * 100 + "12345</p>"))[0][6]
    assert plain == pytest.approx(5 / 505)


def test_means_over_places_are_means_over_paths():
    page = '<div class="a b"><p>one<p>two <b class="c">three</b></div><ul id="menu"><li>x<li>y</ul>tail'
    found, table = h.blocks(page), np.random.default_rng(1).normal(size=(h.PATH_SLOTS, 3)).astype(np.float32)
    paths = h.Paths.joined([h.Paths.of(found), h.Paths.of(found[:2])])
    slots = lambda b: [h._slot(m, h.PATH_SLOTS) for m in b.path]
    want = np.array([table[slots(b)].mean(0) if b.path else np.zeros(3) for b in [*found, *found[:2]]])
    assert np.allclose(paths.means(table), want, atol=1e-6)
    into, grad = np.random.default_rng(2).normal(size=want.shape).astype(np.float32), np.zeros_like(table)
    paths.add_gradient(grad, into)
    plain = np.zeros_like(table)
    for b, g in zip([*found, *found[:2]], into):
        for k in slots(b):
            plain[k] += g / len(b.path)
    assert np.allclose(grad, plain, atol=1e-6)
