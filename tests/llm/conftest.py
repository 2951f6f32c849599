import pytest


@pytest.fixture
def reads(spark):
    """Builds a table of reads from (repo, path, text) or fuller rows, with an extra column of a clashing name."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            repo, path, text, *rest = r
            status = rest[0] if rest else "read"
            at = rest[1] if len(rest) > 1 else f"2025-01-01 00:00:{i % 60:02d}"
            full.append((i, repo, path, status, rest[2] if len(rest) > 2 else None, text, at, "x"))
        df = spark.createDataFrame(full, "read_id bigint, repo_id string, path string, status string, reason string, text string, at string, lines string")
        return df.selectExpr("read_id", "repo_id", "path", "status", "reason", "text", "cast(at as timestamp_ntz) as read_at", "lines")

    return build

