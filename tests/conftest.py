import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from weft.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    return session


def product(product_id="PRD1001", ordinal=0, **values):
    """One catalog row as a dict."""
    row = {
        "ordinal": ordinal, "product_id": product_id, "product_name": "Blue Slim Fit Jeans",
        "category": "jeans", "subcategory": "Slim Denim", "gender": "Men", "color": "Blue",
        "size": "M", "fit": "Slim Fit", "material": "Denim", "brand": "Brand",
        "price_inr": 1999.0, "rating": 4.5, "season": "All-Season",
        "description": "A blue denim jean.",
    }
    return {**row, **values}


CATALOG_SCHEMA = (
    "ordinal long, product_id string, product_name string, category string, "
    "subcategory string, gender string, color string, size string, fit string, "
    "material string, brand string, price_inr double, rating double, season string, "
    "description string"
)


def catalog_of(spark, rows):
    names = [part.split()[0] for part in CATALOG_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], CATALOG_SCHEMA)
