import json

import pytest
from codestrata import cli

from .helpers import make_tree
from .test_projects import FILES


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return make_tree(tmp_path_factory.mktemp("cli"), FILES, ["void"])


def call(spark, capsys, *args):
    code = cli.run(spark, cli.parser().parse_args(list(args)))
    return code, capsys.readouterr().out


def test_views(spark, root, tmp_path, capsys):
    code, out = call(spark, capsys, root)
    assert code == 0 and "[CRIT] Loose root files (1)" in out and "shop · pnpm · Next.js 14" in out
    code, out = call(spark, capsys, root, "--json")
    assert code == 1 and json.loads(out)["issue_count"] > 0
    code, out = call(spark, capsys, root, "--tree", "--depth", "2")
    assert code == 0 and "void/" in out
    code, out = call(spark, capsys, root, "--recommend")
    assert code == 0 and "src/app/  routes" in out
    code, out = call(spark, capsys, root, "--scripts", str(tmp_path))
    assert code == 0 and len(out.split()) == 3 and "git mv" in (tmp_path / "migration-0.sh").read_text()


def test_bad_calls(spark, capsys):
    assert call(spark, capsys, "/no/such/folder")[0] == 1
    with pytest.raises(SystemExit) as e:
        cli.parser().parse_args(["--depth", "x"])
    assert e.value.code == 1
