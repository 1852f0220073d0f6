"""The command line, on four cities."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marlstone.cli import main


@pytest.fixture
def cities(tmp_path):
    path = tmp_path / "cities.parquet"
    pq.write_table(pa.table({"id": [1, 2, 3, 4], "name": ["Rosario", "Cordoba", "Buenos Aires", None], "pop": [1300000, 1400000, 3100000, 500], "capital": [False, False, True, False]}), path)
    return str(path)


def test_commands(spark, cities, capsys):
    def says(*args):
        code = main([args[0], cities, *args[1:]], spark)
        out = capsys.readouterr()
        return code, out.out.splitlines()

    assert says("row-count", "--filter", "pop > 1000 AND capital = false") == (0, ["2"])
    assert says("cat", "--filter", "id = 4", "--columns", "pop,name", "--format", "csv") == (0, ["name,pop", ",500"])
    assert says("cat", "--filter", "name IS NULL", "--format", "json") == (0, ['{"id":4,"pop":500,"capital":false}'])
    assert says("head", "--limit", "1", "--columns", "id") == (0, ["id=1"])
    assert says("schema") == (0, ["id: bigint", "name: string", "pop: bigint", "capital: boolean"])
    assert says("explain", "--filter", "pop > 9000000", "--format", "json")[1][0].count('"verdict":"none"') == 1
    assert len(says("stats", "--format", "csv")[1]) == 5
    assert says("cat", "--filter", "upper(name) = 'X'")[0] == 5
    assert says("cat", "--filter", "nope = 1")[0] == 3
