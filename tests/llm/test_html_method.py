"""The differencing against a plain version that shares no code with it, at several partition counts; what hints decide."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import html_extract

REACH, SUPPORT = 6, 6


def render(blocks):
    """[(place, text)] -> html; places: out, title, in, comment, advert."""
    html, open_ = [], False
    for place, text in blocks:
        inside = place in ("title", "in", "comment in")
        if inside != open_:
            html.append("<article>" if inside else "</article>")
            open_ = inside
        html.append({"title": "<h1>{}</h1>", "comment in": "<div class='comments'>{}</div>", "comment": "<div id='comments'><p>{}</p></div>", "advert": "<div class='sponsor'>{}</div>"}.get(place, "<p>{}</p>").format(text))
    return "<body>" + "".join(html) + ("</article>" if open_ else "") + "</body>"


def aligned(a, b):
    """Indices of a longest common subsequence in a."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def plain(pages):
    """[(page_id, url, blocks)] -> {page_id: text}, by whole hosts in order."""
    hosts = {}
    for i, url, blocks in pages:
        host, _, path = url.partition("://")[2].partition("/")
        hosts.setdefault(host, []).append(("/" + path, url, i, blocks))
    out = {}
    for held in hosts.values():
        runs = []
        for _, _, i, blocks in sorted(held, key=lambda p: p[:3]):
            if runs and runs[-1][0] == blocks:
                runs[-1][1].append(i)
            else:
                runs.append((blocks, [i]))
        kept = [[(p in ("title", "in"), p, t) for p, t in blocks if p in ("out", "title", "in")] for blocks, _ in runs]
        bags = [Counter(w for *_, t in lines for w in t.split()) for lines in kept]
        for k, (_, ids) in enumerate(runs):
            order = sorted((j for j in range(len(runs)) if 0 < abs(j - k) <= REACH), key=lambda j: (abs(j - k), j < k))
            others = [kept[j] for j in order if sum((bags[k] & bags[j]).values()) < 0.8 * max(sum(bags[k].values()), sum(bags[j].values()))]
            mine = kept[k]
            both = [aligned([(x[0], x[2]) for x in mine], [(x[0], x[2]) for x in o]) for o in others[:SUPPORT]]

            def place(lines, i):
                inside = [n for n, x in enumerate(lines) if x[0]]
                return (lines[i][2], inside.index(i)), (lines[i][2], inside.index(i) - len(inside))

            def goes(i):
                if not both or i not in both[0]:
                    return False
                if not mine[i][0]:
                    return True
                same = [any(set(place(mine, i)) & set(place(o, j)) for j in range(len(o)) if o[j][0]) for o in others[:SUPPORT]]
                return mine[i][1] != "title" and len(others) >= SUPPORT and all(i in s for s in both) and all(same)

            text = "\n\n".join(x[2] for i, x in enumerate(mine) if not goes(i))
            out |= dict.fromkeys(ids, text)
    return out


def made(n):
    """Pages of three hosts, one with most of them: template lines in and around articles, paragraphs that recur by chance, comments, adverts, runs of copies."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(300)]
    say = lambda k: " ".join(r.choices(words, k=k))
    chance = [say(9) for _ in range(12)]
    rows, last = [], {}
    for i in range(n):
        host = r.choice(["h.org"] * 6 + ["d.org", "e.org"])
        story = [("in", r.choice(chance) if r.random() < 0.3 else say(9)) for _ in range(r.randint(1, 5))]
        blocks = [("out", f"Motto of {host}"), ("title", "Daily"), *story, ("in", f"Tell a friend of {host}"), ("comment in", say(60)), ("out", "Write to us"), ("comment", say(90)), ("advert", say(80))]
        if r.random() < 0.4 and host in last:
            blocks = last[host]
        if i in range(40, 60):  # a long run of copies
            host, blocks = "h.org", [("out", "Motto of h.org"), ("title", "Copied"), ("in", "one story told often"), ("in", "Tell a friend of h.org")]
        last[host] = blocks
        rows.append((i, f"https://{host}/{'b' if i in range(40, 60) else r.choice('abc')}/{i:04}", blocks))
    return rows


@pytest.mark.parametrize("partitions", ["1", "4", "12"])
def test_differencing(spark, monkeypatch, partitions):
    monkeypatch.setattr(html_extract, "SAMPLED", 2)  # many small blocks
    rows = made(160)
    want = plain(rows)
    df = spark.createDataFrame([(i, u, render(b)) for i, u, b in rows], "page_id long, url string, html string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want
    # paragraphs of articles stay, whatever else recurs; what is the same at the end of all of them goes
    for i, _, blocks in rows:
        assert all(t in got[i] for p, t in blocks if p == "in" and "Tell a friend" not in t)
    assert sum("Tell a friend" in t for t in got.values()) < 25 and not any("Motto of h.org" in t for t in got.values())


def texts(spark, rows, partitions="1"):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return got


def test_comments_and_adverts_go_however_long(spark):
    article = " ".join(f"a{i}" for i in range(30))
    noise = "".join(f"<p>{'very long reader remark ' * 8}{i}</p>" for i in range(25))
    pages = [f"<article><p>{article}</p><div class='comments'>{noise}</div></article>", f"<article><p>{article}</p></article><div class='comments'>{noise}</div>", f"<div class='sponsor'>{noise}</div><article><p>{article}</p></article>", f"<p>{article}</p><div class='comments'>{noise}</div>"]
    got = texts(spark, [(i, None, h) for i, h in enumerate(pages)])
    assert got == dict.fromkeys(range(4), article)


def test_hints(spark):
    """Class words hint at boxes only; a box around the whole article, or around all there is, takes nothing."""
    pages = [
        "<article><p class='share-price'>Shares fell</p><h2 class='banner'>Markets</h2><div class='share'>Tell a friend</div></article>",
        "<div class='widget'><p>all there is</p></div>",
        "<div class='sidebar-layout'><article><p>story</p><div class='comments'>remark</div></article><p>other</p></div><div class='ad'>buy</div>",
    ]
    df = spark.createDataFrame([(i, None, h) for i, h in enumerate(pages)] + [(None, "https://x.org/a", "<p>" + "a " * 300_000 + "</p>")], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("content", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[0] == "Shares fell\n\nMarkets" and got[1] == "all there is" and got[2] == "story\n\nother" and len(got[None]) == 599_999


@pytest.mark.parametrize("partitions", ["1", "12"])
def test_any_number_of_copies_is_looked_past(spark, partitions):
    page = lambda x: f"<body><p>Motto of the site</p><p>{x} {x}1 {x}2</p><p>Write to us</p></body>"
    rows = [(i, f"https://h.org/{i:03}", page("copied")) for i in range(60)] + [(99, "https://h.org/999", page("other"))]
    assert texts(spark, rows, partitions) == dict.fromkeys(range(60), "copied copied1 copied2") | {99: "other other1 other2"}
