"""Word lists that assign categories to annotations."""

# Categories and their words, in the order in which they are tried.
KEYWORDS = {
    "structural": [
        "capsid", "coat", "envelope", "spike", "matrix", "tail", "fiber", "portal", "shell", "head", "virion", "glycoprotein", "membrane protein",
        "membrane-associated", "nucleocapsid", "nucleoprotein", "tegument", "baseplate", "assembly", "maturation", "fusion protein",
        "fusion glycoprotein", "fusion", "attachment", "structural polyprotein", "surface protein", "surface antigen", "surface glycoprotein",
        "core protein", "core antigen", "outer capsid", "inner capsid", "hemagglutinin", "neuraminidase", "gag polyprotein", "gag-pro-pol",
        "pre-membrane",
    ],
    "replication": [
        "polymerase", "replicase", "helicase", "primase", "rdrp", "reverse transcriptase", "rep protein", "nsp12", "nsp13", "phosphoprotein",
        "polymerase cofactor",
    ],
    "protease": [
        "protease", "proteinase", "peptidase", "maturase", "3cl", "mpro", "nsp5",
    ],
    "nuclease": [
        "nuclease", "endonuclease", "exonuclease", "integrase", "recombinase", "ligase", "rnase", "dnase",
    ],
    "packaging": [
        "terminase", "packaging", "scaffold", "portal protein",
    ],
    "host_interaction": [
        "interferon antagonist", "immune evasion", "immune antagonist", "interferon inhibitor", "innate immune", "accessory protein", "viroporin",
        "immune modulator", "ion channel protein", "v protein", "anti-restriction", "anti-crispr", "anti-defense", "host shutoff", "host defense",
        "host division inhibitor", "host cell division inhibitor", "host takeover", "ocr", "dgtpase inhibitor",
    ],
    "regulatory": [
        "transcription", "repressor", "activator", "regulator", "anti-repressor", "antirepressor", "translation enhancer", "translation effector",
        "effector protein", "leader protein", "nonstructural protein", "non-structural protein", "transactivator", "trans-activating",
        "immediate-early", "methyltransferase",
    ],
    "movement": [
        "movement", "cell-to-cell", "transport protein", "movement protein", "plasmodesmata", "tubule-forming", " mp",
    ],
    "lysis": [
        "lysin", "holin", "endolysin", "spanin", "lysis",
    ],
    "entry": [
        "viral entry", "cell entry", "receptor binding", "receptor-binding", "entry protein",
    ],
}

# Words of protein-domain names.
DOMAINS = {
    "structural": [
        "capsid", "coat protein", "matrix protein", "virion", "envelope", "glycoprotein", "spike", "nucleocapsid", "nucleoprotein", "vp1", "vp2",
        "vp3", "vp4", "vp5", "vp6", "vp7", "major capsid", "minor capsid", "picornavirus capsid", "circovirus capsid", "polyomavirus coat",
        "parvovirus coat", "vesiculovirus matrix", "rhabdovirus spike", "herpes virus major capsid", "herpesvirus vp23", "herpesvirus glycoprotein",
        "adenovirus hexon", "adenovirus penton", "fiber protein", "tail protein", "baseplate", "portal protein", "head protein", "tegument",
        "membrane protein", "structural envelope", "assembly protein", "maturation protein", "fusion protein", "fusion glycoprotein",
        "attachment protein", "coronavirus m matrix", "surface protein", "surface antigen", "surface glycoprotein", "core protein", "hemagglutinin",
        "neuraminidase", "gag polyprotein", "pre-membrane protein", "outer capsid protein", "inner capsid protein",
    ],
    "replication": [
        "polymerase", "rdrp", "rna-dependent rna polymerase", "dna polymerase", "reverse transcriptase", "helicase", "rna helicase", "dna helicase",
        "primase", "dna primase", "replicase", "rep protein", "parvovirus non-structural", "ns1", "nsp12", "nsp13", "viral helicase",
        "superfamily 1 rna helicase", "superfamily 2 helicase", "phosphoprotein", "polymerase cofactor", "thymidine kinase", "thymidylate",
        "ribonucleotide reductase", "dutpase", "uracil dna glycosylase",
    ],
    "protease": [
        "protease", "peptidase", "proteinase", "maturase", "assemblin", "3cl protease", "mpro", "nsp5", "serine endopeptidase", "cysteine protease",
        "cysteine proteinase", "cysteine-type peptidase", "metalloprotease", "aspartic protease", "otu", "ovarian tumor",
    ],
    "nuclease": [
        "nuclease", "endonuclease", "exonuclease", "rnase", "dnase", "integrase", "recombinase", "ligase", "dna ligase", "rna ligase", "dutpase",
        "uracil dna glycosylase", "dna/rna non-specific endonuclease", "pd-(d/e)xk", "giy-yig", "hnh", "restriction enzyme",
    ],
    "packaging": [
        "terminase", "packaging", "scaffold", "dna packaging", "genome packaging", "portal", "ul6",
    ],
    "regulatory": [
        "transcription", "transcriptional regulator", "repressor", "activator", "regulator", "anti-repressor", "trans-activator", "transactivator",
        "immediate-early", "protein kinase", "kinase domain", "translation enhancer", "translation effector", "translation regulation",
        "methyltransferase", "cap methyltransferase",
    ],
    "host_interaction": [
        "interferon antagonist", "interferon inhibitor", "immune evasion", "immune antagonist", "innate immune", "stat inhibitor",
        "nf-kappa-b inhibitor", "accessory protein", "viroporin", "immune modulator", "anti-restriction", "anti-crispr", "anti-defense",
        "host defense inhibitor", "host nuclease inhibitor",
    ],
    "movement": [
        "movement protein", "cell-to-cell", "transport protein", "tubule-forming",
    ],
    "lysis": [
        "lysin", "holin", "endolysin", "spanin", "lysis", "lysozyme", "muramidase", "amidase", "peptidoglycan",
    ],
}

# Words of structural superfamily names.
SUPERFAMILIES = {
    "structural": [
        "viral glycoprotein", "positive stranded ssrna viruses", "vsv matrix protein", "ev matrix protein", "group i dsdna viruses",
        "viral glycoprotein ectodomain", "ndv fusion glycoprotein", "wssv envelope", "p40 nucleoprotein", "nucleoprotein", "immunoglobulin",
        "flaviviral glycoprotein", "herpesvirus glycoprotein b",
    ],
    "replication": [
        "dna/rna polymerases", "p-loop containing nucleoside triphosphate hydrolases", "ribonuclease h-like",
        "beta and beta-prime subunits of dna dependent rna-polymerase", "dna ligase/mrna capping enzyme", "dna clamp",
    ],
    "protease": [
        "cysteine proteinases", "metalloproteases", "zincins",
    ],
    "nuclease": [
        "dnase i-like", "dutpase-like", "pin domain-like",
    ],
    "regulatory": [
        "s-adenosyl-l-methionine-dependent methyltransferases", "protein kinase-like", "ankyrin repeat", "ring/u-box",
        "tata-box binding protein-like", "dna-binding domain of mlu1-box", "fkbp12-rapamycin-binding domain",
    ],
    "host_interaction": [
        "bcl-2 inhibitors of programmed cell death", "viroporin",
    ],
}

# Words of biological processes.
PROCESSES = {
    "structural": [
        "viral capsid assembly", "virion assembly", "viral particle assembly", "capsid assembly",
    ],
    "replication": [
        "dna replication", "viral genome replication", "viral dna genome replication", "viral rna genome replication", "rna-templated transcription",
        "dna-templated transcription", "telomere maintenance", "tmp biosynthetic process", "thymidine biosynthetic process",
        "nucleotide biosynthetic process", "deoxyribonucleotide biosynthetic process",
    ],
    "protease": [
        "proteolysis", "viral protein processing", "protein processing",
    ],
    "nuclease": [
        "dna repair", "dna recombination", "dna integration",
    ],
    "packaging": [
        "viral dna genome packaging", "dna packaging", "genome packaging", "chromosome organization",
    ],
    "regulatory": [
        "regulation of dna-templated transcription", "positive regulation of dna-templated transcription", "negative regulation of transcription",
        "viral transcription", "protein phosphorylation", "regulation of dna replication",
    ],
    "host_interaction": [
        "virus-mediated perturbation of host defense response", "modulation by virus of host process", "immune response", "immune evasion",
        "modulation by virus of host immune response", "suppression by virus of host immune response", "evasion of host immune response",
    ],
    "entry": [
        "fusion of virus membrane with host plasma membrane", "virion attachment to host cell", "viral entry", "membrane fusion",
    ],
    "lysis": [
        "lysis", "cell lysis", "host cell lysis",
    ],
}

# Words of molecular functions.
FUNCTIONS = {
    "structural": [
        "structural molecule activity", "structural constituent of virion",
    ],
    "replication": [
        "dna-directed 5'-3' rna polymerase activity", "rna-dependent rna polymerase activity", "dna-directed dna polymerase activity",
        "dna polymerase activity", "dna-directed 5'-3' dna polymerase activity", "dna helicase activity", "rna helicase activity",
        "dna primase activity", "dna binding", "nucleotide binding", "atp binding", "atp hydrolysis activity", "single-stranded dna binding",
        "kinase activity",
    ],
    "protease": [
        "serine-type endopeptidase activity", "cysteine-type peptidase activity", "metalloendopeptidase activity",
        "aspartic-type endopeptidase activity", "peptidase activity",
    ],
    "nuclease": [
        "nuclease activity", "endonuclease activity", "exonuclease activity", "dna ligase activity", "rna ligase activity",
        "endodeoxyribonuclease activity",
    ],
    "regulatory": [
        "protein kinase activity", "methyltransferase activity", "transcription factor activity",
    ],
}

# Layer names of two conventions, layers that both share, and equivalents on the larger model.
LAYER_PREFIX = ("blocks.", "decoder.layers.")
SUBLAYERS = {".mlp.l3": ".mlp.linear_fc2", ".mlp.l1": ".mlp.linear_fc1", ".mlp.l2": ".mlp.linear_fc1"}
SHARED_LAYERS = ("embedding", "decoder.final_norm", "output_layer")
LARGE_MODEL_LAYERS = {"blocks.28.mlp.l3": "blocks.20.mlp.l3", "blocks.28.mlp.l1": "blocks.20.mlp.l1", "blocks.14.mlp.l3": "blocks.10.mlp.l3"}
LARGE_MODEL_LAST_BLOCK, LARGE_MODEL_FALLBACK = 24, 20


def words(table: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(category, word) in the order in which they are tried."""
    return [(category, word) for category, row in table.items() for word in row]
