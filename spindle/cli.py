"""A console: ``python -m spindle.cli [script.sql]``."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterable
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from .display import result_text
from .engine import Engine
from .sources.script import complete

DEFAULT_DIR = "spindle-data"
SETTINGS = Path.home() / ".spindle.json"


class Console:
    """Reads lines; runs what it holds at each line that completes a statement."""

    def __init__(self, engine: Engine, out: TextIO, settings: Path = SETTINGS):
        self.engine, self.out, self.settings, self.held = engine, out, settings, ""

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def line(self, line: str) -> bool:
        """False if the console ends."""
        word = line.strip()
        if not self.held.strip():
            self.held = ""
            if word.rstrip(";").strip().lower() in ("exit", "quit", "\\q"):
                return False
            if word.startswith("\\"):
                self.command(word.rstrip(";").split(None, 1))
                return True
        self.held += line if line.endswith("\n") else line + "\n"
        if complete(self.held):
            self.flush()
        return True

    def flush(self) -> None:
        text, self.held = self.held.strip(), ""
        if not text.strip("; \n"):
            return
        begun = time.time()
        result = self.engine.execute(text)
        try:
            self.say(result_text(result, time.time() - begun))
        except Exception as e:  # a lazy result fails when it is shown
            self.say(f"Error: {e}")

    def command(self, words: list[str]) -> None:
        if words[0] == "\\path":
            if len(words) > 1:
                where = DEFAULT_DIR if words[1].strip() == "default" else words[1].strip()
                self.engine.move(where)
                self.settings.write_text(json.dumps({"data_dir": where}))
            self.say(f"Data folder: {self.engine.data_dir}")
        elif words[0] == "\\checkpoint":
            self.engine.checkpoint()
            self.say("OK" if self.engine.store else "No database selected")
        else:
            self.say(f"Error: unknown command {words[0]}")

    def run(self, lines: Iterable[str]) -> None:
        for line in lines:
            if not self.line(line):
                return
        self.flush()


def saved_dir(settings: Path = SETTINGS) -> str:
    try:
        return json.loads(settings.read_text())["data_dir"]
    except (OSError, ValueError, KeyError):
        return DEFAULT_DIR


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("spindle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    console = Console(Engine(spark, saved_dir()), sys.stdout)
    console.run(open(args[0]) if args else sys.stdin)


if __name__ == "__main__":
    main(sys.argv[1:])
