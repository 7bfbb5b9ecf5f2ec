"""Command line: ``python -m framewright preprocess|stack|export``."""

from __future__ import annotations

import argparse
import json

from framewright.config import Settings
from framewright.plans import pipeline
from framewright.session import build_session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="framewright")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, help_ in (("preprocess", "measure and screen a capture"), ("stack", "stack a preprocessed capture"),
                        ("export", "write the selected frames as a new SER capture")):
        command = commands.add_parser(name, help=help_)
        command.add_argument("capture")
        command.add_argument("selection", help="folder of the stored selection")
        if name != "preprocess":
            command.add_argument("target")
        command.add_argument("--settings", default="{}", help="JSON object of settings")
    args = parser.parse_args(argv)
    settings = Settings.from_dict(json.loads(args.settings))
    spark = build_session()
    if args.command == "preprocess":
        pipeline.preprocess(spark, args.capture, args.selection, settings)
        return
    screened = pipeline.load_selection(spark, args.capture, args.selection)
    if args.command == "export":
        from framewright.sources.ser import export_ser

        export_ser(spark, args.capture, pipeline.chosen(screened, settings), args.target)
    else:
        pipeline.save(*pipeline.stack(spark, args.capture, screened, settings), settings, args.target)


if __name__ == "__main__":
    main()
