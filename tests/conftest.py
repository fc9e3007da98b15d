from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proofline.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def scan_frame(spark, images: dict):
    """Scanlines from ``{image_id: [rows][cols] of (r, g, b, a)}``."""
    from proofline import schemas

    rows = []
    for image_id, img in images.items():
        h, w = len(img), len(img[0])
        for y, line in enumerate(img):
            rows.append((image_id, w, h, y, *[[int(px[c]) for px in line] for c in range(4)]))
    return spark.createDataFrame(rows, schemas.SCANLINES)


def as_grid(scan) -> dict:
    """Inverse of :func:`scan_frame`."""
    out: dict = {}
    for row in scan.orderBy("image_id", "y").collect():
        out.setdefault(row.image_id, []).append(list(zip(row.r, row.g, row.b, row.a)))
    return out
