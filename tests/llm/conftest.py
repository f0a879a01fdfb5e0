import pytest

from faultline.llm.staging import shipped

@pytest.fixture(scope="session")
def docs(spark):
    """Documents with further columns whose names the operators use inside."""
    shipped(spark)

    def make(*rows):
        full = [(i, t, "en", s, len(t or ""), 1, 2, "x", 3, 4, "y") for i, t, s in ((*r, "a")[:3] for r in rows)]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                  "id bigint, root bigint, bucket string, size bigint, _id bigint, recipe string"
        )

    return make
