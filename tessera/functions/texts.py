"""Parsers of text that tools print: regular expressions and JSON over a string column, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What GNU time -v prints, and the names kept.
GNU_TIME = {
    "Command being timed": "command", "User time (seconds)": "usertime", "System time (seconds)": "systemtime", "Percent of CPU this job got": "cpu",
    "Elapsed (wall clock) time (h:mm:ss or m:ss)": "elapsed", "Average shared text size (kbytes)": "avgtext", "Average unshared data size (kbytes)": "avgdata",
    "Average stack size (kbytes)": "avgstack", "Average total size (kbytes)": "avgtotal", "Maximum resident set size (kbytes)": "maxrss",
    "Average resident set size (kbytes)": "avgrss", "Major (requiring I/O) page faults": "major_pagefaults", "Minor (reclaiming a frame) page faults": "minor_pagefaults",
    "Voluntary context switches": "voluntaryswitches", "Involuntary context switches": "involuntaryswitches", "Swaps": "swaps", "File system inputs": "fileinputs",
    "File system outputs": "fileoutputs", "Socket messages sent": "socketsend", "Socket messages received": "socketrecv", "Signals delivered": "signals",
    "Page size (bytes)": "page_size", "Exit status": "status",
}
VMAF_METRICS = ("vmaf", "psnr_y", "psnr_cb", "psnr_cr", "psnr_hvs", "psnr_hvs_y", "psnr_hvs_cb", "psnr_hvs_cr", "float_ssim", "float_ms_ssim", "cambi")
SPS_KEYS = {"profile_idc": "profile", "general_level_idc": "level", "video_full_range_flag": "fr", "colour_primaries": "cp", "transfer_characteristics": "tc", "matrix_coeffs": "mc"}
COLOUR_KEYS = {"colour_primaries": "cp", "transfer_characteristics": "tc", "matrix_coefficients": "mc", "video_full_range_flag": "fr"}
# Columns of the statistics that are read.
QP_FIELDS = ("qp_avg", "qp_stddev", "qp_num", "qp_min", "qp_max")
CTU_FIELDS = tuple(f"ctu{n}{w}_ratio" for w in ("", "w") for n in (8, 16, 32, 64))
# Metadata keys as the tools print them, which are dropped, and renamed to the names that result tables have.
DROPPED_KEYS = (
    "exif:ThumbnailOffset", "exif:ThumbnailLength", "exif:ThumbnailImage", "exif:MakerNoteUnknownText", "icc:ProfileCMMType", "icc:ProfileDateTime", "icc:ProfileFileSignature",
    "icc:PrimaryPlatform", "icc:CMMFlags", "icc:DeviceManufacturer", "icc:DeviceModel", "icc:DeviceAttributes", "icc:RenderingIntent", "icc:ProfileCreator", "icc:ProfileID",
)
RENAMED_KEYS = {
    "icc:ProfileVersion": "icc:profile_version", "icc:ProfileClass": "icc:profile_class", "icc:ProfileCopyright": "icc:profile_copyright", "icc:ColorSpaceData": "icc:color_space",
    "icc:ProfileConnectionSpace": "icc:profile_connection_space", "icc:ProfileDescription": "icc:profile_description", "icc:ChromaticAdaptation": "icc:chromatic_adaptation",
    "icc:MediaWhitePoint": "icc:media_white_point", "icc:ConnectionSpaceIlluminant": "icc:xyz_illuminant", "icc:RedMatrixColumn": "icc:red_matrix_column",
    "icc:GreenMatrixColumn": "icc:green_matrix_column", "icc:BlueMatrixColumn": "icc:blue_matrix_column", "icc:RedTRC": "icc:red_trc", "icc:BlueTRC": "icc:blue_trc", "icc:GreenTRC": "icc:green_trc",
}


def gnu_time_fields(text: Column, names: list[str] | None = None) -> Column:
    """A struct of a GNU time report: integers, seconds, percent; elapsed time in seconds; user plus system time. The report is cut into lines once; what it does not say is null. names: the fields that are looked for, all if not given."""
    wanted = set(names or (*GNU_TIME.values(), "usersystemtime"))
    added = {"usertime", "systemtime"} if "usersystemtime" in wanted else set()

    def fields(lines: Column) -> Column:
        def after(key: str) -> Column:
            line = F.get(F.filter(lines, lambda s: F.startswith(s, F.lit(key + ": "))), F.lit(0))
            return F.nullif(F.rtrim(F.substring(line, F.lit(len(key) + 3), F.length(line))), F.lit(""))

        raw, out = {name: after(key) for key, name in GNU_TIME.items() if name in wanted | added}, {}
        for name, c in raw.items():
            if name == "command":
                out[name] = c
            elif name in ("usertime", "systemtime"):
                out[name] = c.try_cast("double")
            elif name == "cpu":
                out[name] = F.rtrim(F.translate(c, "%", "")).try_cast("double")
            elif name == "elapsed":
                parts = F.reverse(F.split(c, ":"))  # seconds, minutes, hours
                out[name] = F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0)) * 3600 + F.get(parts, F.lit(1)).try_cast("double") * 60 + F.get(parts, F.lit(0)).try_cast("double")
            else:
                out[name] = c.try_cast("long")
        if added:
            out["usersystemtime"] = out["usertime"] + out["systemtime"]
        return F.struct(*[c.alias(k) for k, c in out.items() if k in wanted])

    lines = F.transform(F.split(F.translate(text, "\r", ""), "\n"), lambda s: F.ltrim(F.translate(s, "\t", " ")))
    return F.get(F.transform(F.array(lines), fields), F.lit(0))


def gnu_time(text: Column) -> dict[str, Column]:
    """The fields of gnu_time_fields as columns."""
    all_fields = gnu_time_fields(text)
    return {k: all_fields[k] for k in [*GNU_TIME.values(), "usersystemtime"]}


def psnr_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"average:([0-9.]+)", 1).try_cast("double"), F.lit(-1.0))


def ssim_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"SSIM Y:([0-9.]+)", 1).try_cast("double"), F.lit(-1.0))


def vmaf_of(text: Column) -> dict[str, Column]:
    return {"vmaf:" + m: F.get_json_object(text, f"$.pooled_metrics.{m}.mean").try_cast("double") for m in VMAF_METRICS}


def container_items(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """item_id, id, type, size, rem, primary of every item that a container listing names."""
    primary = F.regexp_extract(text, r"Primary Item - ID (\d+)", 1).try_cast("int")
    lines = df.select(*by, primary.alias("_p"), F.explode(F.filter(F.split(text, "\n"), lambda s: F.startswith(s, F.lit("Item #")))).alias("_l"))
    item = lambda k: F.regexp_extract("_l", r"Item #(\d+): ID (\d+) type (\w*)(.*)", k)
    size = F.nullif(F.regexp_extract("_l", r" size (\S*)", 1), F.lit(""))
    rem = F.when(size.isNull(), item(4)).otherwise(F.regexp_extract("_l", r" size \S*(.*)", 1))
    return lines.select(*by, item(1).cast("int").alias("item_id"), item(2).cast("int").alias("id"), item(3).alias("type"), size.alias("size"), rem.alias("rem"), F.coalesce(item(2).cast("int") == F.col("_p"), F.lit(False)).alias("primary"))


def settings(text: Column, keys: dict[str, str], prefix: str, sign: str = "=") -> Column:
    """A map of prefixed names to the integers that follow the keys; keys that do not occur are left out."""
    import re

    pairs = [F.struct(F.lit(prefix + short).alias("k"), F.regexp_extract(text, re.escape(k) + r"\s*" + sign + r"\s*(-?\d+)", 1).try_cast("int").alias("v")) for k, short in keys.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def colour_box(xml: Column) -> Column:
    """A map of the colour information box of a container's XML, which is parsed once for all its values."""
    names = {"colour_type": "colour_type", "colour_primaries": "cp", "transfer_characteristics": "tc", "matrix_coefficients": "mc", "full_range_flag": "fr"}
    # U+0001 stands in no XML 1.0 text
    found = F.split(F.call_function("xpath_string", xml, F.lit("concat(" + ", '\x01', ".join(f"//ColourInformationBox/@{n}" for n in names) + ")")), "\x01")
    keys = F.array(*[F.lit("colr:" + short) for short in names.values()])
    said = F.filter(F.arrays_zip(keys.alias("k"), F.coalesce(found, F.array().cast("array<string>")).alias("v")), lambda p: p["v"] != "")
    return F.map_from_entries(said)


def converted_file(text: Column, wanted: Column) -> Column:
    """Which file a converter wrote: the wanted one, or the first of several images."""
    images = F.regexp_extract(text, r"File contains (\d+) image", 1).try_cast("int")
    written = F.transform(F.filter(F.split(text, "\n"), lambda s: F.startswith(s, F.lit("Written to "))), lambda s: F.substring(s, F.lit(12), F.length(s)))
    return F.when(F.array_contains(written, wanted), wanted).when(images > 1, F.get(written, F.lit(0))).otherwise(wanted)


def reduced_metadata(meta: Column) -> Column:
    """Keys dropped and renamed; other keys stay."""
    kept = F.map_filter(meta, lambda k, v: ~k.isin(*DROPPED_KEYS))
    names = F.create_map(*[F.lit(x) for p in RENAMED_KEYS.items() for x in p])
    return F.transform_keys(kept, lambda k, v: F.coalesce(F.try_element_at(names, k), k))


def prefixed(meta: Column, prefix: str) -> Column:
    return F.transform_keys(meta, lambda k, v: F.concat(F.lit(prefix), k))


def escaped_float(q: str) -> Column:
    """97.5 as 97_5, 95.0 as 95."""
    return F.expr(f"case when {q} = floor({q}) then cast(cast({q} as bigint) as string) else replace(cast({q} as string), '.', '_') end")


def extension_of(path: str) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def colour_range(text: Column) -> Column:
    """full, limited or unspecified."""
    t = F.lower(text)
    return F.when(t.isin("full", "fr", "1"), "full").when(t.isin("limited", "lr", "0"), "limited").otherwise("unspecified")
