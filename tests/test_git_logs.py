"""Exported logs and paths followed over renames."""

import random

from textloom.sources import git_logs as g

LOG = """noise before
__COMMIT__c6|2024-06-01T00:00:00Z|Eve
M\tdocs/b.md
A\tdocs/a.md

__COMMIT__c5|2024-05-01T00:00:00Z|Dan|d@x
R090\tdocs/c.md\tdocs/b.md
__COMMIT__c4|2024-04-01T00:00:00Z|a|b@c|d

R100\told/b.md\tdocs/c.md
D\tother.md
__COMMIT__c3|2024-03-01T00:00:00Z|Bob
R075\tdocs/a.md\told/b.md
__COMMIT__c2|2024-02-01T00:00:00Z|Ann
__COMMIT__c1|2024-01-01T00:00:00Z|Ann
A\tdocs/a.md
M\tother.md
"""


def test_file_renamed_three_times(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.log").write_text(LOG, encoding="utf-8")
    (tmp_path / "two.log").write_bytes(b"__COMMIT__x1|2024-01-01|\xff\nA\tdocs/b.md\r\n")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "readme.txt").write_text("no log")
    changes = g.read_changes(spark, str(tmp_path))
    assert changes.rdd.getNumPartitions() == 3
    got = {(r.repo, r.file, r.seq): (r.commit, r.author, r.path) for r in g.path_history(changes).collect()}
    assert {k[2]: v for k, v in got.items() if k[:2] == ("one", "docs/b.md")} == {0: ("c6", "Eve", "docs/b.md"), 1: ("c5", "Dan", "docs/b.md"), 2: ("c4", "a", "docs/c.md"), 3: ("c3", "Bob", "old/b.md"), 5: ("c1", "Ann", "docs/a.md")}
    # the path is another file when it is added again
    assert {k[2]: v[0] for k, v in got.items() if k[:2] == ("one", "docs/a.md")} == {0: "c6"}
    assert got["two", "docs/b.md", 0] == ("x1", "�", "docs/b.md")
    history = {(r.repo, r.file, r.seq): (r.mail, str(r.day)) for r in g.file_history(changes).collect()}
    assert history["one", "other.md", 2] == ("b@c|d", "2024-04-01") and history["one", "docs/b.md", 1] == ("d@x", "2024-05-01")


def test_missing_logs(spark, tmp_path):
    assert g.read_changes(spark, f"file://{tmp_path}/none", lenient=True).count() == 0
    assert g.path_history(g.read_changes(spark, f"file://{tmp_path}/none", lenient=True)).count() == 0
    try:
        g.read_changes(spark, str(tmp_path / "none")).count()
    except Exception as e:  # the reader's own error, wrapped by Spark
        assert "none" in str(e)
    else:
        raise AssertionError("a missing log must fail")


def walked(rows):
    """Each change's last path, by replaying the repository from its oldest commit."""
    where, seen = {}, []
    for seq in sorted({r[1] for r in rows}, reverse=True):
        commit = [r for r in rows if r[1] == seq]
        moved = {r[7]: where.pop(r[7], object()) for r in commit if r[6] == "R" and r[7] in where}
        for r in commit:
            if r[6] == "R":
                where[r[8]] = moved.get(r[7], object())
            elif r[6] == "A":
                where[r[8]] = object()
            seen.append((r, where.setdefault(r[8], object())))
    last = {}
    for r, file in seen:
        last[file] = r[8]
    return sorted((r[1], r[8], last[file]) for r, file in seen)


def test_random_renames_equal_replay(spark):
    rng = random.Random(2)
    rows, alive, fresh = [], [], 0
    for seq in range(120, -1, -1):
        for i in rng.sample(range(len(alive)), min(len(alive), rng.randrange(3))):
            if rng.random() < 0.5:
                new = f"f{fresh}" if rng.random() < 0.7 else f"g{rng.randrange(4)}"
                fresh += 1
                if new not in alive:
                    rows.append(("r", seq, f"c{seq}", "t", "a", "", "R", alive[i], new))
                    alive[i] = new
            else:
                rows.append(("r", seq, f"c{seq}", "t", "a", "", "M", None, alive[i]))
        if len(alive) < 6:
            alive.append(f"n{seq}")
            rows.append(("r", seq, f"c{seq}", "t", "a", "", "A", None, f"n{seq}"))
    got = g.followed(spark.createDataFrame(rows, g.CHANGES)).collect()
    assert sorted((r.seq, r.path, r.file) for r in got) == walked(rows)
