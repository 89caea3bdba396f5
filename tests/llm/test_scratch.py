from pathlib import Path

from sightline.llm.scratch import application_folder, drop_scratch, materialize


def test_tables_are_read_back_and_dropped_together(spark):
    other = Path(application_folder(spark).removeprefix("file://")).parent / "another-application"
    other.mkdir(parents=True, exist_ok=True)
    try:
        for n in (0, 3):
            assert sorted(r.id for r in materialize(spark.range(n), "numbers").collect()) == list(range(n))
        assert drop_scratch(spark) and not Path(application_folder(spark).removeprefix("file://")).exists()
        assert not drop_scratch(spark) and other.exists()
        assert materialize(spark.range(2), "numbers").count() == 2
    finally:
        other.rmdir()
