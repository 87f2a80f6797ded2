import random
import re
import time

import pytest

from lodestone.llm import html_paths as H

NAV = "<nav><ul>" + "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(9)) + "</ul></nav>"


def page(body, cls="post-12 entry"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='</p>'</script></head><body>{NAV}<div class='{cls}'>{body}</div><!-- gone --><footer>(c) us</footer></body></html>"


LONG = "<p>" + "Prose, with commas, that goes on. " * 12 + "</p>"


def test_parse_mends():
    root = H.parse("<div><p>one<p>two<b>bold<p>three</div>tail")
    assert H.text_of(root) == "one\ntwobold\nthree\ntail"
    assert H.text_of(H.parse("<ul><li>a<li>b</ul>x &amp; y<br>z")) == "a\nb\nx & y\nz"
    assert H.text_of(H.parse("<script>if (a<b) {}</script>ok <!-- <p>no</p> --> end")) == "ok end"


def test_best_container():
    path, score = H.best(page(LONG))
    assert path == "html/body/div.entry.post" and score > 0
    assert H.best("just text") is None and H.extract("just text", None) == ("page", "page", "just text")


def test_consensus(spark):
    side = "<div class='aside-1'>" + LONG * 3 + "</div>"
    rows = [(i, f"https://Host.example/{i}", page(LONG, f"entry post-{i}")) for i in range(4)]
    rows += [(4, "https://host.example/odd", page("<p>Short.</p>", "entry post-4").replace("<footer>", side + "<footer>"))]  # its own best is the aside
    rows += [(5, "http://other.example/", page(LONG, "main")), (6, None, None), (7, "no host", ""), (8, "https://host.example/x", "<p>bare")]
    got = {r["page_id"]: r for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 9
    assert got[4]["used"] == "consensus" and got[4]["text"] == "Short." and got[4]["n_votes"] == 4 and got[4]["n_pages"] == 5
    assert got[0]["path"] == "html/body/div.entry.post" and got[0]["host"] == "host.example"
    assert got[6]["text"] is None and got[7]["text"] is None and got[6]["host"] == ""
    assert got[8]["used"] == "page" and got[8]["text"] == "bare"


def test_votes_against_brute_force(spark):
    from collections import Counter

    rows = [(i, f"http://h{i % 3}.example/", page(LONG * (1 + i % 2), ["a", "b", "c-7"][i * 7 % 3])) for i in range(30)]
    won = {r["host"]: (r["path"], r["n_votes"]) for r in H.winners(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host in won:
        mine = [H.best(h) for i, u, h in rows if host in u]
        count, score = Counter(p for p, _ in mine), Counter()
        for p, s in mine:
            score[p] += round(s, 3)
        best = min(count, key=lambda p: (-count[p], -score[p], p))
        assert won[host] == (best, count[best])


def test_odd_pages(spark):
    rows = [(None, "http://a/", page(LONG), "h"), (1, "http://a/", "<" * 1000, "h"), (1, "http://a/", "<div>" * 3000 + "x", "h"), (2, "http://a/", "<p " + "y" * 100_000, "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    assert H.main_text(df).count() == 4 and H.main_text(df.limit(0)).count() == 0


HOSTILE = {
    "tags without an end": "<a b " * 1_000_000, "stray ends": "<div>" * 100_000 + "</b>" * 400_000, "deep": "<div>" * 200_000 + "x", "inline around blocks": "<b>" * 100_000 + "<div>y</div>" * 100_000,
    "quotes": '<a ">"' * 100_000, "paragraphs in spans": "<span>" * 100_000 + "<p>x</p>" * 100_000, "comments": "<!-- " * 1_000_000, "class": "<div " + "class " * 500_000 + ">x", "brackets": "<" * 1_000_000, "scripts": "<script>" * 500_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_long_odd_pages_take_no_longer(name):
    began = time.monotonic()
    found = H.best(HOSTILE[name])
    H.extract(HOSTILE[name], found[0] if found else "html/body/div")
    assert time.monotonic() - began < 20


def tree(rng, depth=0):
    """(tag, classes, parts) at random: parts are texts and such trees."""
    tag = rng.choice(["div", "section", "article", "span", "nav", "ul", "footer"]) if depth else "body"
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.4 and depth < 4:
            parts.append(tree(rng, depth + 1))
        elif kind < 0.7:
            parts.append(("p", [], [words(rng), ("a", [], [words(rng)]), words(rng)][: rng.randint(1, 3)]))
        else:
            parts.append(words(rng))
    return tag, [rng.choice(["post-7", "w-1/2", "menu", "x9", "entry"]) for _ in range(rng.randint(0, 2))], parts


def words(rng):
    return " ".join(rng.choice(["word,", "more", "of", "text", "&amp;"]) for _ in range(rng.randint(1, 30)))


def source(x):
    if isinstance(x, str):
        return x
    tag, classes, parts = x
    return f'<{tag} class="{" ".join(classes)}">' + "".join(map(source, parts)) + f"</{tag}>"


def naive(x, above=()):
    """(path, score, text) of each container, from the tree itself, as the module's docstring tells it."""
    nodes = []

    def visit(x, chain):
        tag, classes, parts = x
        general = sorted({re.sub(r"[0-9]+", "", c).strip("-_") for c in classes} - {""}) if tag in H._BLOCK else []
        me = (*chain, (len(nodes), tag, ".".join([tag, *general]), f"{tag} {' '.join(general)}"))
        nodes.append((me, x))
        for p in parts:
            if not isinstance(p, str):
                visit(p, me)

    def size(x):
        if isinstance(x, str):
            return len(x.strip()), 0, x.count(",")
        n, linked, commas = map(sum, zip((0, 0, 0), *map(size, x[2])))
        return n, n if x[0] == "a" else linked, commas

    def text(x):
        if isinstance(x, str):
            return x.replace("&amp;", "&")
        inner = "".join(map(text, x[2]))
        return f"\n{inner}\n" if x[0] in H._BLOCK else inner

    visit(x, above)
    score = {}
    for me, x in nodes:
        own = [p for p in x[2] if isinstance(p, str)]
        if x[0] == "p":
            n, linked, commas = size(x)
        elif x[0] in H._CONTAINER and any(own):
            n, linked, commas = sum(len(p.strip()) for p in own), 0, sum(p.count(",") for p in own)
        else:
            continue
        share = 1.0
        for k, tag, *_ in reversed(me if x[0] in H._CONTAINER else me[:-1]):
            if tag in ("nav", "footer") or share <= 0.1:
                break
            if tag in H._CONTAINER:
                score[k] = score.get(k, 0) + (n / 100 + commas) * (1 - linked / n) * share
                share /= 2
    out = []
    for me, x in nodes:
        if me[-1][0] in score:
            n, linked, _ = size(x)
            weight = (1.25 if H._GOOD.search(me[-1][3]) else 1) * (0.2 if H._BAD.search(me[-1][3]) else 1)
            lines = (" ".join(line.split()) for line in text(x).split("\n"))
            out.append(("/".join(m[2] for m in me), score[me[-1][0]] * weight * (1 - linked / n), "\n".join(line for line in lines if line)))
    return [c for c in out if c[1] > 0]


@pytest.mark.parametrize("seed", range(40))
def test_extraction_against_brute_force(seed):
    x = tree(random.Random(seed))
    page, found = source(x), naive(x)
    root = H.parse(page)
    got = [(n.path(), n.score, H.text_of(n)) for n in H.containers(root)]
    assert [(p, pytest.approx(v), t) for p, v, t in found] == got
    if found:
        top = max(found, key=lambda c: c[1])
        assert H.best(page) == (top[0], pytest.approx(top[1])) and H.extract(page, None) == (top[0], "own", top[2])
    for path in {c[0] for c in found}:
        assert H.extract(page, path)[2] == "\n".join(t for p, _, t in found if p == path)
