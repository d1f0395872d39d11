"""Corpus, retrieval and evidence analytics on Spark."""


def ship(spark) -> None:
    """Send this package to the executors of a session whose workers can't import it, as when it isn't installed there and
    the session wasn't started in its folder. Call it once, before the first query."""
    import shutil
    import tempfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    # on the driver; Spark copies it to the executors itself
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='ship-')}/{here.name}", "zip", here.parent, here.name)
    spark.sparkContext.addPyFile(made)
