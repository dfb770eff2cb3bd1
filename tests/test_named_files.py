"""Files named in a text, and anchors gained after a fetch."""

from tessera.plans.anchor import anchors, append_gained, claims_of, reanchored
from tessera.sources.named_files import MAX_FILE_BYTES, named_paths, read_named


def test_names_of_a_text():
    assert named_paths("Look at @notes, `src/a.py` and /tmp/*.md, not https://x.org/a.html. Is it b.txt? 3 of 4, b.txt") == ["notes", "src/a.py", "/tmp/*.md", "b.txt"]
    assert named_paths(None) == named_paths("Why is **this** so?") == []


def test_sections_of_named_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\n```\ncode\n```\n")
    (tmp_path / "b.txt").write_text("two  \n")
    (tmp_path / "c.bin").write_bytes(b"x\x00y")
    (tmp_path / "long.log").write_text("z" * (MAX_FILE_BYTES + 5))
    text = f"Compare {tmp_path}/b.txt with @{tmp_path}/*.md, {tmp_path}/c.bin, {tmp_path}/none.txt, {tmp_path}/b.txt and {tmp_path}/long.log"
    got = sorted(tuple(r) for r in read_named(spark, text).collect())
    assert [p.rsplit("/", 1)[1] for _, p, _ in got] == ["b.txt", "a.md", "long.log"]
    assert got[0][2].endswith("/b.txt\n```txt\ntwo\n```")
    assert "\n````md\none\n" in got[1][2] and got[1][2].endswith("\n````")
    assert got[2][2].endswith("z\n... [truncated]\n```")
    assert read_named(spark, "Nothing is named here").count() == 0


def test_full_context(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"{n}.txt").write_text("w" * 150_000)
    got = sorted(tuple(r) for r in read_named(spark, f"@{tmp_path}/*.txt").collect())
    assert [len(section) > 150_000 for _, _, section in got] == [True, True, True, False]


def test_anchors_gained(spark, tmp_path):
    claims = claims_of(spark.createDataFrame([(1, "Rivers carry silt towards coastal plains. Bakers knead sourdough before every sunrise.")], "k long, t string"), "k", "t")
    before = spark.createDataFrame([(10, "Rivers carry silt towards coastal plains.")], "id long, x string")
    after = before.unionByName(spark.createDataFrame([(11, "Bakers knead sourdough before every sunrise.")], "id long, x string"))
    held = anchors(claims, before, "id", "x")
    gained = reanchored(claims, after, "id", "x", held)
    assert [(r.claim_id, r.source) for r in gained.collect()] == [("1-1", 11)]
    path = f"{tmp_path}/gained"
    assert append_gained(gained, path) and spark.read.parquet(path).count() == 1
    assert not append_gained(reanchored(claims, before, "id", "x", held), path)
    assert spark.read.parquet(path).count() == 1
