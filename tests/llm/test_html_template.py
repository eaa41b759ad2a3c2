"""Template lines against article text: what differencing of neighbouring pages decides."""

from quarrylight.llm import html_extract


def texts(spark, rows, partitions="1"):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return got


def test_containers_are_differenced(spark):
    """Lines that several near pages share at one place go inside an article too, its title stays; unshared lines outside it stay, as do lines that only one neighbour shares."""

    def page(story, after=""):
        return f"<body><p>Motto of the site</p><article><h1>Daily report</h1>{''.join(f'<p>{x}</p>' for x in story)}<p>Tell a friend</p></article>{after}</body>"

    stories = [["first story told", "and more of it"], ["second tale", "quite unlike the other", "said by both"], ["third thing", "said by both"], *([" ".join(f"{w}{n}" for w in "a story of its own words and matter".split())] for n in range(6))]
    rows = [(i, f"https://h.org/a/{i}", page(s, "<p>Correction to the first story</p>" if not i else "")) for i, s in enumerate(stories)]
    want = {i: "\n\n".join(["Daily report", *s]) for i, s in enumerate(stories)}
    assert texts(spark, rows) == want | {0: want[0] + "\n\nCorrection to the first story"}
    # two pages are no several
    assert all(t.endswith("Tell a friend") for t in texts(spark, rows[:2]).values() if "Correction" not in t)


def test_template_heavy_pages_are_no_copies(spark):
    """Eight template lines of thirteen go; copies do not delete each other, and lose their template to a page that is none."""

    def page(story):
        menu = "".join(f"<p>Entry {i}</p>" for i in range(5))
        return f"<body><p>Motto of the site</p>{menu}{''.join(f'<p>{x}</p>' for x in story)}<p>Write to us</p><p>Made by hand</p></body>"

    stories = {n: [" ".join(f"{n}{k}{i}" for i in range(9)) for k in range(5)] for n in "abc"}
    rows = [(i, f"https://h.org/a/{i}", page(stories[n])) for i, n in enumerate("aabcc")]
    assert texts(spark, rows) == {i: "\n\n".join(stories[n]) for i, n in enumerate("aabcc")}
    same = [(1, "https://d.org/1", page(stories["a"])), (2, "https://d.org/2", page(stories["a"]))]
    assert all(stories["a"][0] in t for t in texts(spark, same).values())
