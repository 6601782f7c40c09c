"""A sync reads entries and log many times; they are worked out from the documents once."""

import os

import pytest

from tidemark import queries
from tidemark.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_what_a_sync_reads_again_is_a_table(spark):
    a, b = queries._with_texts(Fixtures(spark, SF))
    for table in (a.entries, b.entries, a.log, b.log):
        assert table.inputFiles() and not any("documents" in f for f in table.inputFiles())
