"""The archive as a stream: pages are read and parsed once for a batch."""

import json

from analystry.streaming import archive


def page(*posts):
    return "  var blog_api_answer = " + json.dumps({"posts-total": len(posts), "posts": list(posts)}) + ";\n"


def post(slug, day, *urls):
    return {"slug": slug, "type": "photo", "date-gmt": f"{day} 10:00:00", "photos": [{"photo-url-1280": u} for u in urls]}


def test_pages_are_parsed_once(spark, tmp_path, monkeypatch):
    parsed = spark.sparkContext.accumulator(0)
    plain = archive.posts_of

    def counting(pages, body):
        return plain(pages.rdd.map(lambda r: (parsed.add(1), r)[1]).toDF(pages.schema), body)

    monkeypatch.setattr(archive, "posts_of", counting)
    source = tmp_path / "in"
    source.mkdir()
    for name, body in (("a", page(post("p", "2024-01-02", "http://x/1.jpg", "http://x/2.jpg"), post("q", "2024-01-03", "http://x/1.jpg"))),
                       ("b", page(post("p", "2024-01-02", "http://y/1.jpg")))):
        (source / f"{name}.txt").write_text(body)
    paths = str(source), str(tmp_path / "out"), str(tmp_path / "state")
    wanted = [("p", "1.jpg", "02"), ("p", "2.jpg", "02"), ("q", "1.jpg", "03")]
    found = archive.archive_stream(spark, *paths)
    assert sorted((r["slug"], r["file"], r["day"]) for r in found.collect()) == wanted
    assert parsed.value == 2


def test_the_driver_does_not_list_the_pages(spark, tmp_path):
    source, target, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    for k in range(2):
        for i in range(60):
            (source / f"{k}-{i}.txt").write_text(page(post(f"p{k}-{i}", "2024-01-02", f"http://x/{i}.jpg")))
        found = archive.archive_stream(spark, str(source), str(target), str(state))
        assert found.count() == 60 * (k + 1)
    # what the stream remembers are a few tables of names, however many pages there are
    logs = "".join(f.read_text() for f in state.rglob("*") if f.is_file() and f.parent.parent.name == "sources" and not f.name.startswith("."))
    assert logs and ".txt" not in logs and logs.count('"path"') < 60
    names = spark.read.parquet(str(state / "pages"))
    assert names.count() == names.distinct().count() == 120
