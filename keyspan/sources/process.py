"""Processes, one for each row: off unless a caller asks for them.

Running other programs is an effect, not a query: results depend on the machines that
run it, and a lost executor runs a row's program again. So it has to be allowed where
it is called, and programs have to be ones that may run twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: What a row's program left: its output, or the failure that it did not end well.
OUTCOME = T.StructType(
    [
        T.StructField("ok", T.StructType([T.StructField("stdout", T.BinaryType()), T.StructField("stderr", T.BinaryType())])),
        T.StructField("err", T.StructType([T.StructField("code", T.StringType()), T.StructField("exit", T.IntegerType()), T.StructField("stderr", T.StringType())])),
    ]
)


def run_rows(
    df: DataFrame, keys: list[str], argv: str, stdin: str | None = None, env: Mapping[str, str] | None = None, timeout: float = 60.0,
    allow: bool = False, name: str = "outcome",
) -> DataFrame:
    """Key columns and the outcome of running each row's ``argv`` (an array of strings; no shell reads it).

    Programs see only ``env``. A null or empty argv, a program that is not there, an exit code
    other than 0 and a run past ``timeout`` seconds are ``ProcessFailure``s of their row.
    """
    if not allow:
        raise PermissionError("running programs has to be allowed by its caller")
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*(df.schema[k] for k in keys), T.StructField(name, OUTCOME)])
    arrow, given = to_arrow_schema(out), dict(env or {})

    def failed(code: int | None, text: str) -> dict:
        return {"ok": None, "err": {"code": "ProcessFailure", "exit": code, "stderr": text}}

    def one(args: list[str] | None, data: bytes | None) -> dict:
        import subprocess

        if not args:
            return failed(None, "no program")
        try:
            done = subprocess.run(args, input=data or b"", capture_output=True, env=given, timeout=timeout, check=False)
        except subprocess.TimeoutExpired:
            return failed(None, f"still running after {timeout} s")
        except (OSError, ValueError) as e:
            return failed(None, str(e))
        if done.returncode:
            return failed(done.returncode, done.stderr.decode(errors="replace"))
        return {"ok": {"stdout": done.stdout, "stderr": done.stderr}, "err": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args = batch.column(len(keys)).to_pylist()
            data = batch.column(len(keys) + 1).to_pylist() if stdin else [None] * len(args)
            found = [one(a, d.encode() if isinstance(d, str) else d) for a, d in zip(args, data)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, arrow.field(name).type)], schema=arrow)

    return df.select(*keys, argv, *([stdin] if stdin else [])).mapInArrow(run, out)
