"""Walks of source trees: ignore files against git's own verdicts and by hand."""

import random
import subprocess

import pytest

from graphloom.sources import scan, tree

RULES = ["*.py", "/build", "docs/", "!keep.py", "a/**/c.py", "**/x", "x/**", "b?.ts", "[ab]*.go", "[!a]z.py", "#no", "\\#yes.py", "", "  ", "d/e", "!d/e/f.py", "!docs/", "sp ace.py", "tail.py  ", "*", "!*/", "!*.ts", "a.b+c.py", "k*/*.ts"]


def put(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_by_hand(spark, tmp_path):
    put(tmp_path, {
        ".git/info/exclude": "secret.py\n", ".gitignore": "*.gen.py\n/top.py\ntmp/\n", "sub/.gitignore": "!own.gen.py\nlocal.py\n", "sub/.ignore": "!local.py\n",
        "a.py": "x = 1\n", "a.gen.py": "", "top.py": "", "sub/top.py": "", "sub/own.gen.py": "", "sub/other.gen.py": "", "sub/local.py": "", "tmp/t.py": "", "sub/tmp/deep/t.py": "",
        "secret.py": "", "_under.py": "", ".hidden.py": "", "node_modules/n.py": "", "types.d.ts": "", "pyproject.toml": "[project]\nname = 'p'\n", "sub/package.json": "{}", "notes.txt": "",
    })
    files, manifests = scan.walk(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["_under.py", "a.py", "sub/local.py", "sub/own.gen.py", "sub/top.py"]
    assert files.filter("path = 'a.py'").first().text == "x = 1\n"
    assert sorted(r.path for r in manifests.collect()) == ["pyproject.toml", "sub/package.json"]


def test_without_a_repository_only_plain_ignore_files_count(spark, tmp_path):
    put(tmp_path, {".gitignore": "a.py\n", ".ignore": "b.py\n", "a.py": "", "b.py": ""})
    assert [r.path for r in scan.walk(spark, str(tmp_path))[0].collect()] == ["a.py"]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_git(spark, tmp_path, seed):
    r = random.Random(seed)
    names = ["x", "a", "b", "docs", "d", "e", "build", "k1"]
    leaves = ["keep.py", "c.py", "b1.ts", "a.go", "bz.py", "az.py", "#yes.py", "sp ace.py", "tail.py", "f.py", "x", "a.b+c.py", "aab_c.py", "build", "q.ts"]
    for _ in range(120):
        path = "/".join([*(r.choice(names) for _ in range(r.randrange(4))), r.choice(leaves)])
        try:
            put(tmp_path, {path: ""})
        except (FileExistsError, IsADirectoryError, NotADirectoryError):
            pass
    folders = [tmp_path, *[p for p in tmp_path.rglob("*") if p.is_dir()]]
    for f in [tmp_path, *r.sample(folders, 5)]:
        (f / ".gitignore").write_text("\n".join(r.sample(RULES, 5)) + "\n")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True, timeout=60)
    told = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.quotePath=false", "-c", "core.excludesFile=/dev/null", "ls-files", "-o", "--exclude-standard"], check=True, capture_output=True, text=True, timeout=60).stdout.splitlines()
    got = [x.path for x in tree.files(spark, str(tmp_path), ()).collect()]
    assert sorted(got) == sorted(x for x in told if not x.endswith(".gitignore"))


def test_null_and_repeated_paths(spark, monkeypatch):
    paths = spark.createDataFrame([(None, 1), ("a/b", 2), ("a/b", 3), ("c", 4)], "path string, regex int")
    known = tree.rules(spark.createDataFrame([("", 1, "a/"), ("", 1, None)], "dir string, rank int, text string"))
    for most in (10, 0):  # broadcast and shuffled
        monkeypatch.setattr(tree, "BROADCAST_RULES", most)
        assert sorted(tree.not_ignored(paths, known).collect(), key=str) == sorted([(None, 1), ("c", 4)], key=str)
        assert tree.not_ignored(paths, known.limit(0)).count() == 4
