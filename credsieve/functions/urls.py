"""Parts of repository URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repository_parts(url: Column) -> Column:
    """Struct (server, collection, project, repository, problem) of a ``.../_git/<name>`` URL.

    The four parts are null when ``problem`` says why the URL cannot be read.
    """
    server = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1)
    steps = F.split(F.trim(path, F.lit("/")), "/")
    at = F.array_position(steps, "_git").cast("int")
    problem = (
        F.when(at == 0, "no _git in the URL")
        .when(at >= F.size(steps), "no repository name after _git")
        .when(at < 2, "no project before _git")
    )

    def part(value: Column) -> Column:
        return F.when(problem.isNull(), value)

    return F.struct(
        part(server).alias("server"),
        part(F.array_join(F.slice(steps, 1, F.greatest(at - 2, F.lit(0))), "/")).alias("collection"),
        part(F.get(steps, at - 2)).alias("project"),
        part(F.get(steps, at)).alias("repository"),
        problem.alias("problem"),
    )
