"""Page streams over tables that are one file, a folder of files, or nothing yet."""

from pagegraph.operators.triples import COLUMNS
from pagegraph.streaming import loads

PAGES = [(i, f"https://a.example/{i}", f"<title>t{i}</title>") for i in range(6)]


def pages(spark, path, n_files):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(n_files).write.parquet(path)


def test_table_of_several_files_is_streamed_whole(spark, tmp_path):
    pages(spark, f"{tmp_path}/pages.parquet", 3)
    pages(spark, f"{tmp_path}/other.parquet", 1)
    rows = loads.run_to_table(loads.page_stream(spark, str(tmp_path), "pages.parquet", per_trigger=1), f"{tmp_path}/table").collect()
    assert sorted(tuple(r) for r in rows) == PAGES
    loads.load_pages(loads.page_stream(spark, str(tmp_path), "pages.parquet", per_trigger=2), f"{tmp_path}/store")
    titles = loads.read_store(spark, f"{tmp_path}/store").filter("p LIKE '%title'").select("o").collect()
    assert sorted(r.o for r in titles) == [f"t{i}" for i in range(6)]


def test_table_of_one_file_is_streamed(spark, tmp_path):
    pages(spark, f"{tmp_path}/all", 1)
    one, = (tmp_path / "all").glob("*.parquet")
    (tmp_path / "pages.parquet").write_bytes(one.read_bytes())
    rows = loads.run_to_table(loads.page_stream(spark, str(tmp_path), "pages.parquet"), f"{tmp_path}/table").collect()
    assert sorted(tuple(r) for r in rows) == PAGES


def test_stream_without_a_file_gives_an_empty_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    loads.load_pages(loads.page_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/store")
    store = loads.read_store(spark, f"{tmp_path}/store")
    assert store.columns == list(COLUMNS) and store.count() == 0
