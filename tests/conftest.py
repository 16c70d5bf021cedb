from __future__ import annotations

import os
import sys
from datetime import UTC, datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from termloom import schemas  # noqa: E402
from termloom.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


@pytest.fixture
def assignments(spark):
    """Source rows from dicts; what is not given is null."""

    def build(*rows: dict):
        base = {"student_id": 1, "course_id": "c", "type": "homework", "source_platform": "d2l", "status": "available", "is_submitted": False}
        names = spark.createDataFrame([], schemas.ASSIGNMENTS.replace("\n", " ")).columns
        full = [{**base, "id": r.get("title"), **r} for r in rows]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schemas.ASSIGNMENTS.replace("\n", " "))

    return build


@pytest.fixture
def courses(spark):
    def build(*rows: dict):
        base = {"student_id": 1, "course_id": "c", "code": "C1", "name": "Course", "d2l_course_id": "9", "d2l_url": "https://lms/d2l/home/9", "semester": "S"}
        names = spark.createDataFrame([], schemas.COURSES.replace("\n", " ")).columns
        return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], schemas.COURSES.replace("\n", " "))

    return build
