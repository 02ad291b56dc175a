"""Transcribe a release: ``python -m vaktavya.inference.cli --provider NAME --release FOLDER --audio-dir FOLDER``."""

from __future__ import annotations

import argparse
import sys

from vaktavya.inference import recognisers
from vaktavya.plans.session import local_session, ship
from vaktavya.plans.settings import settings
from vaktavya.sources.speech import load_release, load_unsupported, supported_rows


def main(argv: list[str] | None = None) -> tuple[int, int]:
    """Run what has no success yet, append to the results, and return how many ids succeeded and how many only failed."""
    options = settings()
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--provider", required=True, help="name under which the recogniser is registered")
    parser.add_argument("--audio-dir", required=True, help="where the wav files are, named by utterance")
    parser.add_argument("--release", "--local-dataset", dest="release", required=True, help="where the release's shards are")
    parser.add_argument("--config", default="all", help="one language's folder instead of all")
    parser.add_argument("--rules", help="JSON table of the languages that recognisers can't do")
    parser.add_argument("--out", help="table of results; named after the recogniser unless given")
    parser.add_argument("--concurrency", type=int, default=options.parallel, help="calls at a time")
    parser.add_argument("--limit", type=int, help="take up this many utterances only")
    parser.add_argument("--cpus", default="*", help="threads of the local session")
    args = parser.parse_args(argv)
    spark = local_session(args.cpus)
    ship(spark)
    try:
        maker = recognisers.get_maker(args.provider)
        release = load_release(spark, args.release, args.config)
    except (FileNotFoundError, KeyError, ValueError) as error:
        sys.exit(f"error: {error}")
    rows = supported_rows(release, args.provider, load_unsupported(args.rules) if args.rules else None)
    out = args.out or f"{args.provider}_predictions"
    results = recognisers.resume(
        rows, recognisers.audio_files(spark, args.audio_dir), maker, out, args.limit,
        parallel=args.concurrency, interval=options.interval_seconds, attempts=options.recogniser_attempts,
    )
    done, lost = recognisers.tallies(results).first()
    print(f"{out}: {done:,} utterances transcribed, {lost:,} without success" + (", to be taken up by the next run" if lost else ""))
    return done, lost


if __name__ == "__main__":
    main()
