"""The package reaches workers that can't import it."""

import subprocess
import sys
from pathlib import Path

RUN = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {repo!r})  # the driver alone
import passageworks
passageworks.ship(spark)
from passageworks.sources import pages
print("pages", pages.parse_pages(spark.createDataFrame([(1, "https://a.org/x", "<title>t</title>")], "page_id long, url string, html string")).first()["page_title"])
"""


def test_workers_outside_the_folder(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    out = subprocess.run([sys.executable, "-c", RUN.format(repo=repo)], cwd=tmp_path, capture_output=True, text=True, timeout=240, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "pages t" in out.stdout, out.stderr[-2000:]
