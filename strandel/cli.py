"""Command line: group masks, measure widths, order depth, draw tubes, tune, over a folder of scenes."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import functions as F

from strandel import config
from strandel.operators import encoding, meshes
from strandel.operators.agreement import assign_fragments
from strandel.plans import depth, group, joint, measure, tune
from strandel.session import session
from strandel.sources import files, images


def _rules(args: argparse.Namespace, section: str):
    named = dict(x.split("=", 1) for x in args.set or [] if x.split("=", 1)[0] in {f.name for f in dataclasses.fields(config.SECTIONS[section])})
    return config.build(section, named)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandel")
    parser.add_argument("stage", choices=["group", "joint", "measure", "depth", "tune"])
    parser.add_argument("--scenes", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--mask", default="mask.png")
    parser.add_argument("--image", default="sem.png")
    parser.add_argument("--truth", default="gt_multilabel.npz")
    parser.add_argument("--tubes", action="store_true", help="with depth: also vertices and faces of tubes")
    parser.add_argument("--budget", type=int, default=300)
    parser.add_argument("--force", action="store_true", help="with tune: write the best settings even if they are no better")
    parser.add_argument("--tuned")
    parser.add_argument("--set", action="append", metavar="NAME=VALUE")
    args = parser.parse_args(argv)
    known = {f.name for kind in config.SECTIONS.values() for f in dataclasses.fields(kind)}
    for x in args.set or []:
        if x.split("=", 1)[0] not in known:
            raise SystemExit(f"no parameter {x.split('=', 1)[0]}")
    rule = _rules(args, "group")
    if args.tuned:  # an explicit --set wins over the file
        rule = config.apply_tuned(config.GroupRule(), args.tuned, {k: getattr(rule, k) for k in (x.split("=", 1)[0] for x in args.set or []) if hasattr(rule, k)})
    spark = session("strandel")
    scenes, pixels = images.read_masks(spark, args.scenes, args.mask)
    if args.stage == "group":
        encoding.encode(group.instances(pixels, scenes, rule), scenes).write.mode("overwrite").parquet(args.out)
    elif args.stage == "joint":
        encoding.encode(joint.joint_instances(pixels, images.read_greys(spark, args.scenes, args.image), rule, _rules(args, "joint")), scenes).write.mode("overwrite").parquet(args.out)
    elif args.stage == "tune":
        truth, pieces = files.read_truth(spark, args.scenes, args.truth), group.fragments(pixels, scenes)
        if scenes.count() == 1:  # a single scene is cut into tiles, which are the folds
            pixels, scenes, truth = tune.tile_scenes(pixels, scenes, truth)
            pieces = group.fragments(pixels, scenes)
        votes = pieces.join(assign_fragments(pieces, truth).withColumnRenamed("iid", "gt"), ["scene_id", "frag_id"])
        found = tune.tune(pixels, scenes, votes.cache(), tune.TuneRule(budget=args.budget), rule)
        if found["accept"] or args.force:
            config.write_tuned(args.out, dataclasses.replace(rule, **found["params"]), rule, {"val_base": found["val_base"], "val_best": found["val_best"]})
        return 0 if found["accept"] or args.force else 1
    elif args.stage == "measure":
        found = measure.cuts(pixels, images.read_greys(spark, args.scenes, args.image), rule, _rules(args, "sample"), _rules(args, "cut"))
        files.write_table(measure.bundles(found, _rules(args, "sample")).withColumn("refusals", F.to_json("refusals")), args.out)
    else:
        how = _rules(args, "depth")
        lines = group.axes(pixels, scenes, rule).select("scene_id", "iid", "seq", F.col("c").alias("x"), F.col("r").alias("y"))
        out = depth.run_scenes(lines, images.read_greys(spark, args.scenes, args.image), how)
        files.depth_records(out["instances"], out["crossings"]).write.mode("overwrite").parquet(f"{args.out}/records")
        out["report"].write.mode("overwrite").json(f"{args.out}/report")
        if args.tubes:
            vertices, faces = meshes.tubes(lines, out["instances"])
            vertices.write.mode("overwrite").parquet(f"{args.out}/vertices")
            faces.write.mode("overwrite").parquet(f"{args.out}/faces")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
