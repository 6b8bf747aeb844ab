"""python -m larkspur list | query NAME FOLDER [--out PATH --format F] | validate CONFIG.json | runs FOLDER [CONDITION]
| train CONFIG.json | predict MODEL DATA OUT [csv|parquet|json] [--probabilities] | run CONFIG.json RUN [--again]"""

from __future__ import annotations

import json
import sys


def main(args: list[str]) -> int:
    from larkspur.plans import QUERIES

    if args[:1] == ["list"]:
        print("\n".join(sorted(QUERIES)))
        return 0
    if args[:1] == ["validate"] and len(args) == 2:
        from larkspur.pipeline import check_config, substitute

        with open(args[1]) as f:
            problems = check_config(substitute(json.load(f)), {"data.path": str, "stages": list})
        print("\n".join(problems) or "valid")
        return int(bool(problems))
    if args[:1] == ["query"] and len(args) >= 3:
        from larkspur.session import build
        from larkspur.sources.files import write

        df = QUERIES[args[1]](build(), args[2])
        options = dict(zip(args[3::2], args[4::2], strict=True))
        if "--out" in options:
            write(df, options["--out"], options.get("--format", "parquet"))
        else:
            df.show(50, truncate=False)
        return 0
    if args[:1] == ["runs"] and len(args) in (2, 3):
        from larkspur.pipeline import Tracker
        from larkspur.session import build

        Tracker(build(), args[1]).search(args[2] if len(args) == 3 else "true").orderBy("run").show(50, truncate=False)
        return 0
    if args[:1] == ["train"] and len(args) == 2:
        from larkspur import batch
        from larkspur.session import build

        config = batch.load_config(args[1])
        batch.train(build(), config)
        print(f"{config['output']}/model")
        return 0
    if args[:1] == ["predict"] and len(args) >= 4:
        from larkspur import batch
        from larkspur.session import build

        rest = [a for a in args[4:] if a != "--probabilities"]
        batch.score(build(), *args[1:4], rest[0] if rest else "csv", "--probabilities" in args)
        return 0
    if args[:1] == ["run"] and len(args) >= 3:
        from larkspur import batch
        from larkspur.session import build

        print(json.dumps(batch.run(build(), batch.load_config(args[1]), args[2], "--again" not in args)))
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
