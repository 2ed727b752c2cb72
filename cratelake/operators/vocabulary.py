"""The tag vocabulary and the pilot's quotas."""

from cratelake.operators.tags import Rule

#: The shipped tag rules.
RULES = [
    Rule("909", "gear", origin_matches=("909",), name_matches=("909", "sa909")),
    Rule("808", "gear", origin_matches=("808",), name_matches=("808",)),
    Rule("sp1200", "gear", origin_matches=("sp1200",), name_matches=("sp1200",)),
    Rule("sh101", "gear", origin_matches=("sh101",), name_matches=("sh101", "tapesh101")),
    Rule("303", "gear", origin_matches=("303",), name_matches=("303", "handson303")),
    Rule("cr78", "gear", name_matches=("cr78", "cr-78")),
    Rule("tr8", "gear", origin_matches=("tr-8", "tr8"), name_matches=("tr-8", "tr8")),
    Rule("tape", "gear", name_matches=("tape", "cass", "fatso")),
    Rule("analog", "gear", origin_matches=("analog", "analogue", "super-analog"), name_matches=("analog", "analogue")),
    Rule("techno", "style", origin_matches=("techno",), name_matches=("techno",)),
    Rule("tribal", "style", origin_matches=("tribal",), name_matches=("tribal", "conga", "bongo", "djembe", "cowbell", "timbale")),
    Rule("dub", "style", origin_matches=("echospace", "deepchord", "modulation-space"), name_matches=("dub", "echoes-in-space")),
    Rule("detroit", "style", origin_matches=("detroit",), name_matches=("detroit",)),
    Rule("hardgroove", "style", origin_matches=("hardgroove",), name_matches=("hardgroove",)),
    Rule("acid", "style", origin_matches=("acid", "303"), name_matches=("acid",)),
    Rule("ambient", "style", origin_matches=("ambient", "soundware", "cartel-hall"), name_matches=("ambient", "atmos", "drone", "texture")),
    Rule("dark", "style", origin_matches=("dark", "underground"), name_matches=("dark",)),
    Rule("house", "style", origin_matches=("house",), name_matches=("house",)),
    Rule("subby", "character", roles=("KICKS",), features=(("sub_ratio", ">=", 0.60),)),
    Rule("clicky", "character", roles=("KICKS",), features=(("attack_ms", "<=", 5.0),)),
    Rule("rumble-long", "character", roles=("KICKS",), features=(("tail_ms", ">=", 700.0), ("low_ratio", ">=", 0.55))),
    Rule("short", "character", roles=("KICKS",), features=(("tail_ms", "<=", 250.0),)),
    Rule("metallic", "character", roles=("HATS-CYM",), features=(("flatness", ">=", 0.35), ("centroid_hz", ">=", 3500.0))),
    Rule("tight", "character", roles=("HATS-CYM",), features=(("tail_ms", "<=", 250.0),)),
    Rule("sparse", "character", roles=("DRUM-LOOPS",), features=(("duration_s", ">=", 1.0), ("onset_density", "<=", 2.0))),
    Rule("busy", "character", roles=("DRUM-LOOPS",), features=(("duration_s", ">=", 1.0), ("onset_density", ">=", 8.0))),
    Rule("dub-wash", "character", roles=("DRONE-ATMOS",), features=(("duration_s", ">=", 5.0), ("onset_density", "<=", 1.5), ("centroid_hz", "<=", 1200.0))),
    Rule("wood", "character", roles=("PERC",), name_matches=("wood", "clave", "block", "rim")),
    Rule("processed", "character", name_matches=("_x.", "_x2.", "-x.", "processed")),
    Rule("original", "character", name_matches=("_orig", "-orig", "aorig")),
]
#: How many favourites of each role a pilot needs.
QUOTAS = {
    "KICK": 12, "SNARE": 8, "CLAP": 8, "RIM": 4, "HAT-CLOSED": 10, "HAT-OPEN": 8, "SHAKER": 6, "CYMBAL": 4, "RIDE": 4, "TOM": 8, "PERC": 10, "BASS": 4,
    "STAB-CHORD": 4, "FX": 4, "VOCAL": 2, "DRUM-LOOP": 4, "BASS-LOOP": 2, "SYNTH-LOOP": 2, "VOCAL-LOOP": 4, "TEXTURE-DRONE": 4,
}
