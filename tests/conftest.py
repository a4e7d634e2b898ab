import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docstrata.session import local_session  # noqa: E402
from docstrata.sources.readers import documents_from_json  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of one collection `c`, numbered from 0."""
    import json

    def make(*documents, collection="c"):
        rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
        return documents_from_json(spark.createDataFrame(rows, "doc_id bigint, j string"), collection, "doc_id", "j")

    return make
