"""What to do about a finding: a summary, commands, edits and caveats, as columns of the finding.

Two small tables come in beside the findings, both one row a project: the ignore file's lines
as an array, and the size that large blobs of the history start at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shell_quoted
from .project_gates import ignore_lines, matches_glob

_COMMAND = "struct<run:string,note:string>"
_EDIT = "struct<path:string,op:string,line:int,content:string>"
GUIDED = "This needs a decision: there is no mechanical change for it."


def _commands(*runs: tuple[Column, str | None]) -> Column:
    return F.array(*[F.struct(run.alias("run"), F.lit(note).cast("string").alias("note")) for run, note in runs])


def _edit(path: Column, op: str, content: Column, line: Column | None = None) -> Column:
    at = F.lit(None) if line is None else line
    return F.array(F.struct(path.alias("path"), F.lit(op).alias("op"), at.cast("int").alias("line"), content.alias("content")))


def _texts(*texts: str | Column) -> Column:
    return F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])


def remediation_plan(findings: DataFrame, files: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """findings (project, gate_id, file_path, ...) with summary, confidence, commands, edits, caveats.

    confidence: deterministic with a recipe, else guided. A finding whose place doesn't name what
    the recipe needs is guided. Nothing is added to an ignore file that covers the path already.
    thresholds: (project, threshold_mb) of large blobs; 5 where a project has none.
    """
    gate, place = F.col("gate_id"), F.coalesce("file_path", F.lit(""))
    ignored = ignore_lines(files).groupBy("project").agg(F.collect_set("have").alias("_have"))
    own = findings.join(ignored, "project", "left")
    if thresholds is None:
        own = own.withColumn("_mb", F.lit(5))
    else:
        set_ = thresholds.groupBy("project").agg(F.max("threshold_mb").cast("int").alias("_mb"))
        own = own.join(set_, "project", "left").withColumn("_mb", F.when(F.col("_mb") > 0, F.col("_mb")).otherwise(5))

    folder = F.rtrim(place, F.lit("/"))
    editor = F.coalesce(*[F.when((place == d) | place.startswith(d + "/"), F.lit(d + "/")) for d in (".vscode", ".idea", ".vs")], place)
    line = F.when(gate == "vendored_dir_tracked", F.concat(folder, F.lit("/"))).when(gate == "ide_artifact_tracked", editor)
    bare = F.regexp_replace(line, "^/|/$", "")
    last = F.substring_index(bare, "/", -1)
    covered = F.exists("_have", lambda h: (h == bare) | matches_glob(bare, h) | matches_glob(last, h))
    own = own.withColumn("_line", line).withColumn("_covered", F.coalesce(covered, F.lit(False)))

    pattern = F.regexp_extract(place, r"(?s)^[^:]*:(.+)\z", 1)
    env = r"(?s)^([^:]*):([0-9]{1,9}):(.*)\z"
    env_file, env_line, env_key = (F.regexp_extract(place, env, k) for k in (1, 2, 3))
    recipe = F.when(gate.isin("large_blob_in_history", "secrets_scan_history"), gate)
    recipe = recipe.when((gate == "vendored_dir_tracked") & (folder != ""), gate)
    recipe = recipe.when(gate.isin("ide_artifact_tracked", "unexpected_executable_bit") & (place != ""), gate)
    recipe = recipe.when((gate == "gitignore_coverage") & (pattern != ""), gate)
    recipe = recipe.when((gate == "env_example_uncommented") & (F.try_to_number(env_line, F.lit("999999999")) > 0), gate)
    own = own.withColumn("_recipe", recipe)

    r, mb = F.col("_recipe"), F.col("_mb").cast("string")
    commit = lambda words, what: (F.concat(F.lit("git commit -m "), shell_quoted(F.concat(F.lit(words), what))), None)
    untrack = lambda how, what, words: _commands((F.concat(F.lit(how), shell_quoted(what)), "leaves it on disk"), commit(words, what))
    rewrite = "rewrites every commit: tell all contributors first"
    push = (F.lit("git push --force-with-lease --all"), "publishes the rewritten history")
    commands = (
        F.when(r == "vendored_dir_tracked", untrack("git rm -r --cached ", folder, "stop tracking "))
        .when(r == "ide_artifact_tracked", untrack("git rm --cached ", place, "stop tracking "))
        .when(r == "unexpected_executable_bit", _commands((F.concat(F.lit("git update-index --chmod=-x "), shell_quoted(place)), "clears the bit in the index"), commit("clear the executable bit of ", place)))
        .when(r == "large_blob_in_history", _commands((F.concat(F.lit("git filter-repo --strip-blobs-bigger-than "), mb, F.lit("M")), rewrite), push))
        .when(r == "secrets_scan_history", _commands((F.lit("git filter-repo --replace-text replacements.txt"), f"replacements.txt: a line SECRET==>REDACTED for each; {rewrite}"), push, (F.lit("rm replacements.txt"), "it holds the secret")))
        .otherwise(F.array().cast(f"array<{_COMMAND}>"))
    )
    nothing = F.array().cast(f"array<{_EDIT}>")
    edits = (
        F.when(F.col("_line").isNotNull() & r.isNotNull(), F.when(F.col("_covered"), nothing).otherwise(_edit(F.lit(".gitignore"), "append", F.concat("_line", F.lit("\n")))))
        .when(r == "gitignore_coverage", _edit(F.lit(".gitignore"), "append", F.concat(pattern, F.lit("\n"))))
        .when(r == "env_example_uncommented", _edit(env_file, "insert_before_line", F.concat(F.lit("# TODO: explain what "), env_key, F.lit(" is used for\n")), F.try_to_number(env_line, F.lit("999999999"))))
        .otherwise(nothing)
    )
    history = ("Needs git-filter-repo and a fresh clone.", "All contributors have to clone again or reset to the new history.")
    caveats = (
        F.when(r == "vendored_dir_tracked", _texts("The folder leaves the index of all contributors; their copies stay on disk."))
        .when(r == "env_example_uncommented", _texts(F.concat(F.lit("The comment is a placeholder: say what "), env_key, F.lit(" is for."))))
        .when(r == "large_blob_in_history", _texts(*history))
        .when(r == "secrets_scan_history", _texts("Replace the credential at its issuer first: whatever was committed counts as known.", *history))
        .otherwise(F.array().cast("array<string>"))
    )
    also = F.when(F.col("_covered"), "; .gitignore covers it").otherwise(" and ignore it")
    summary = (
        F.when(r.isin("vendored_dir_tracked", "ide_artifact_tracked"), F.concat(F.lit("Stop tracking "), F.when(r == "vendored_dir_tracked", folder).otherwise(place), also, F.lit(".")))
        .when(r == "gitignore_coverage", F.concat(F.lit("Add "), pattern, F.lit(" to .gitignore.")))
        .when(r == "unexpected_executable_bit", F.concat(F.lit("Clear the executable bit of "), place, F.lit(".")))
        .when(r == "env_example_uncommented", F.concat(F.lit("Say above line "), env_line, F.lit(" of "), env_file, F.lit(" what "), env_key, F.lit(" is for.")))
        .when(r == "large_blob_in_history", F.concat(F.lit("Take blobs over "), mb, F.lit(" MiB out of the history.")))
        .when(r == "secrets_scan_history", "Replace the credential, then take it out of the history.")
        .when(gate == "merge_conflict_markers", F.concat(F.lit("Resolve the conflict at "), place, F.lit(", then add and commit.")))
        .otherwise(GUIDED)
    )
    added = {"summary": summary, "confidence": F.when(r.isNotNull(), "deterministic").otherwise("guided"), "commands": commands, "edits": edits, "caveats": caveats}
    return own.select(*[F.col(c) for c in findings.columns if c not in added], *[c.alias(n) for n, c in added.items()])
