"""The data source of stored pages against the joins of `crawl`, and as a stream with restarts."""

import json
import random

from pyspark.sql import functions as F

from loomwork.sources import pages, stored_pages


def site(rng, hosts):
    out = []
    for h in hosts:
        urls = [f"http://{h}/p{i}" for i in range(30)]
        for u in urls:
            links = rng.sample(urls, 3) + [f"http://{rng.choice(hosts)}/p1", "http://elsewhere.example/x", f"http://{h}/missing", f"{rng.choice(urls)}#part"]
            out.append((u, "".join(f'<p><A class="x" href="{x}">t</a>' for x in links)))
    return out


def store(folder, web, first=0):
    for i, (url, html) in enumerate(web, first):
        own = folder / url.split("/")[2]
        own.mkdir(parents=True, exist_ok=True)
        (own / f"{i:06d}.json").write_text(json.dumps({"url": url, "html": html}))


def test_walks_equal_the_joins(spark, tmp_path):
    stored_pages.register(spark)
    hosts = ["a.example", "b.example", "c.example"]
    web = site(random.Random(3), hosts)
    store(tmp_path, web)
    (tmp_path / "a.example" / "zz.json").write_text("{broken")
    seeds = ["http://a.example/p0", "http://b.example/p5", "http://b.example/p6", "http://unknown.example/"]
    read = spark.read.format("stored_pages").option("path", str(tmp_path)).option("seeds", " ".join(seeds))
    for depth, most in ((0, 80), (2, 80), (3, 7)):
        got = read.option("depth", depth).option("most_pages", most).load()
        want = pages.crawl(spark.createDataFrame(web, "url string, html string"), spark.createDataFrame([(s,) for s in seeds[:3]], "url string"), depth, most)
        assert sorted((r.url, r.depth) for r in got.collect()) == sorted((r.url, r.depth) for r in want.collect())
        assert got.rdd.getNumPartitions() == 2
    assert {r.url: r.html for r in read.load().collect()}.items() <= dict(web).items()


def test_stream_gives_every_page_once_over_restarts(spark, tmp_path):
    stored_pages.register(spark)
    web = site(random.Random(4), ["a.example", "b.example"])
    folder = tmp_path / "pages"

    def follow():
        rows = spark.readStream.format("stored_pages").option("path", str(folder)).load().select("url", F.sha2("html", 256).alias("h"))
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        return sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect())

    store(folder, web[:10])
    assert follow() == sorted(u for u, _ in web[:10])
    store(folder, web[10:45], 10)
    (folder / "b.example" / "999999.json").write_text("no page")
    assert follow() == sorted([*(u for u, _ in web[:45]), "999999.json"])
    assert follow() == sorted([*(u for u, _ in web[:45]), "999999.json"])
