import os

import public_tokenizers
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tokenizer_files():
    return public_tokenizers.path


@pytest.fixture(scope="session")
def bundled():
    if not os.path.isdir(FOLDER):
        pytest.skip("bundled tables are not here")
    return FOLDER
