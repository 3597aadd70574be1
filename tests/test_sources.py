import pytest

from support import DATA, SCALES
from tarnfield.sources import TABLES, read_table


@pytest.mark.parametrize("scale", SCALES)
def test_every_data_file_has_a_reader(scale):
    assert sorted(p.stem for p in (DATA / scale).glob("*.parquet")) == sorted(TABLES)


@pytest.mark.parametrize("name", TABLES)
def test_tables_can_be_read(spark, name):
    assert read_table(spark, str(DATA / "sf0.001"), name).take(1)


def test_base_may_end_in_a_slash(spark):
    assert read_table(spark, f"{DATA}/sf0.001/", "region").count() == 5


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    orders = read_table(spark, str(DATA / "sf0.001"), "orders")
    orders.repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    again = read_table(spark, str(tmp_path), "orders")
    assert again.schema == orders.schema
    assert sorted(again.collect()) == sorted(orders.collect())


def test_unknown_table_is_refused(spark):
    with pytest.raises(ValueError, match="unknown table"):
        read_table(spark, str(DATA / "sf0.001"), "lineitems")
