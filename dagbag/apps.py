"""End-to-end analyses of repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from dagbag.functions import text
from dagbag.operators.history import History
from dagbag.sources.git import Repositories


def _of_contents(repos: Repositories, files: History, f, name: str) -> History:
    """Attach ``f(content)`` to every file; contents are parsed once, not once a
    commit, however many commits share them."""
    wanted = files._values.select("resource").distinct()
    parsed = repos.contents().join(wanted, "resource", "left_semi").select("resource", f(F.col("content")).alias(name))
    rows = files._values.join(parsed, "resource")
    return History.from_frames(files.nodes(), files.edges(), rows.select("node", "path", "resource", name, "val"), ["path", "resource", name])


def complexity(repos: Repositories, history: History | None = None, suffix: str = ".java") -> History:
    """Total cyclomatic complexity of every commit's files."""
    files = repos.resources(history or repos.history(), suffix)
    return _of_contents(repos, files, text.java_complexity, "mcc").tmap(lambda path, resource, mcc: mcc).sum()


def terms_added(repos: Repositories, history: History | None = None, suffix: str = ".java") -> History:
    """Number of terms that every commit with one parent adds."""
    files = repos.resources(history or repos.history(), suffix)
    terms = _of_contents(repos, files, lambda c: text.message_tokens(F.regexp_replace(c, "\\s", " ")), "terms")
    return terms.flat_map(lambda path, resource, t: History.bag(t)).diff(False).added().length()


def lines_of_code(repos: Repositories, history: History | None = None, suffix: str = ".java") -> History:
    """Lines of every commit's files that don't start with a comment mark."""
    files = repos.resources(history or repos.history(), suffix)
    rows = _of_contents(repos, files, text.lines, "lines").flat_map(lambda path, resource, x: History.bag(x))
    return rows.filter(lambda line: ~F.ltrim(line).startswith("//")).length()
