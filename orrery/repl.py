"""An interactive prompt: python -m orrery.repl DATA_ROOT."""

from __future__ import annotations

import getpass
import sys
from collections.abc import Callable

from .engine import Engine

HELP = "End a statement with ; or a line GO. :r FILE or run FILE runs a script, exit or quit ends."


def loop(engine: Engine, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> None:
    """Reads until exit, quit or the end of input."""
    held: list[str] = []
    write(HELP)
    while True:
        try:
            line = read(f"{engine.current or 'sql'}{'...' if held else '>'} ")
        except EOFError:
            return
        word = line.strip()
        if not held and word.lower().rstrip(";") in ("exit", "quit"):
            return
        if not held and (word.lower().startswith(":r ") or word.lower().startswith("run ")):
            try:
                results = engine.execute_script_file(word.split(None, 1)[1])
            except OSError as e:
                write(str(e))
                continue
        elif word.upper() == "GO" or word.endswith(";"):
            held.append("" if word.upper() == "GO" else line)
            results = engine.execute_script("\n".join(held))
            held = []
        else:
            held += [line] if word else []
            continue
        for r in results:
            write(r.render())


def main(arguments: list[str]) -> int:
    from pyspark.sql import SparkSession

    if len(arguments) != 1:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("orrery").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, arguments[0])
    if engine.server.logins():
        for _ in range(3):
            if engine.login(input("login: "), getpass.getpass("password: ")):
                break
            print("Login failed.")
        else:
            return 1
    loop(engine)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
