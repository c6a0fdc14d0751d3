"""Packaged dimensions: lexicons, patterns and small rule tables. All of them are arguments of their operators."""

from __future__ import annotations

# Terms that a text from before modern physics cannot hold.
STRONG_TERMS = (
    "electron", "proton", "neutron", "quantum", "photon", "relativity", "spacetime", "space-time", "dna", "neuron",
    "galaxy", "black hole", "radio wave", "x-ray", "spectrum analysis",
)

# Terms of physics that old translations may use.
SOFT_TERMS = (
    "energy", "field", "vibration", "particle", "atom", "frequency", "wave", "dimension", "force", "matter", "molecule",
    "electric", "magnetic", "gravity",
)

# Vocabulary to mask, with neutral words in its place.
NEUTRAL_WORDS = {
    "energy": "pervasive principle",
    "field": "distributed entity",
    "vibration": "oscillatory change",
    "frequency": "rate of recurrence",
    "particle": "localized entity",
    "wave": "propagating disturbance",
    "quantum": "discrete unit",
    "dimension": "aspect",
    "resonance": "sympathetic response",
    "information": "structured content",
    "observer": "witnessing agent",
    "atom": "indivisible constituent",
    "force": "influence",
    "electromagnetic": "interaction-mediating",
    "photon": "light quantum-analogue term",
    "electron": "charged constituent",
    "spin": "intrinsic orientation",
    "entanglement": "nonseparable correlation",
    "superposition": "joint representation of alternatives",
    "waveform": "disturbance profile",
}

# Patterns that give a text's origin away, base and extended.
LEAK_PATTERNS = (
    r"\bupani[sṣ]ad\b", r"\bved[aā]nta\b", r"\bbhagavad\b", r"\bquantum\b", r"\bch[aā]ndogya\b", r"\bb[rṛ]had[aā]ra[nṇ]yaka\b",
    r"\bvai[sś]e[sṣ]ika\b", r"\bka[nṇ][aā]da\b", r"\b[aā]k[aā][sś]a\b", r"\bindia\b", r"\bsanskrit\b", r"\bveda\b", r"\blucretius\b",
    r"\btimaeus\b", r"\bmaxwell\b",
)

# Families of names to scrub.
SCRUB_FAMILIES = (
    ("tradition_vaisesika", r"\bvai[sś]e[sṣ]ika\b"),
    ("author_kanada", r"\bka[nṇ][aā]da\b"),
    ("term_akasa", r"\b[aā]k[aā][sś]a\b"),
    ("term_sabda", r"\b[sś]abda\b"),
    ("geo_india", r"\b(india|indian|sanskrit|hindu|vedic|veda|vedānta|vedanta)\b"),
    ("work_upanishad", r"\bupani[sṣ]ad\b"),
    ("work_gita", r"\bbhagavad\b"),
    ("greek_names", r"\b(lucretius|epicurus|plato|aristotle|timaeus|stoic|democritus)\b"),
    ("chinese_names", r"\b(dao|tao|laozi|lao[- ]?tzu|confucius)\b"),
    ("buddhist_names", r"\b(dhammapada|buddha|buddhist|abhidhamma|abhidharma)\b"),
    ("modern_physics_names", r"\b(maxwell|einstein|newton|schr[oö]dinger|heisenberg|feynman|dirac)\b"),
    ("quantum_word", r"\bquantum\b"),
)

# Line beginnings of editors.
EDITORIAL = ("commentary:", "editor:", "note:")
EDITORIAL_SCRUB = (*EDITORIAL, "translator:")

# What features stand for in a passage's graph: (nodes, edge or None).
FEATURE_GRAPH = {
    "O01": (("substrate",), None),
    "O02": (("whole", "constituent"), ("whole", "composed_of", "constituent")),
    "O03": (("constituent",), None),
    "O04": (("substrate", "space"), ("substrate", "pervades", "space")),
    "O05": (("substrate", "manifestation"), ("substrate", "manifests_as", "manifestation")),
    "O06": (("whole", "property"), ("property", "emerges_from", "whole")),
    "D01": (("state",), None),
    "D02": (("state",), ("state", "transforms_into", "state")),
    "D03": (("motion",), None),
    "D04": (("disturbance", "space"), ("disturbance", "propagates_through", "space")),
    "F01": (("substrate", "space"), ("substrate", "pervades", "space")),
    "F07": (("manifestation", "substrate"), ("manifestation", "emerges_from", "substrate")),
    "M02": (("measurement", "state"), ("measurement", "changes", "state")),
    "M03": (("observer", "property"), None),
    "Q01": (("state",), None),
    "Q06": (("whole", "constituent"), ("whole", "cannot_be_reduced_to", "constituent")),
}

# Entity families of the structural extractor, in the order in which they are tried.
ENTITY_FAMILIES = (
    ("particle", "particle_atom", r"\b(particle|corpuscle|atom|molecule|electron|proton|neutron|photon|quark)\b"),
    ("medium_or_field", "field_medium", r"\b(field|medium|ether|æther|aether|vacuum|space)\b"),
    ("interaction", "interaction", r"\b(force|interaction|collision|attraction|repulsion)\b"),
    ("property", "property", r"\b(energy|momentum|charge|mass|entropy|temperature|pressure|potential|spin)\b"),
    ("observable", "observable", r"\b(wave|radiation|light|sound|heat|current|flux)\b"),
    ("state", "state", r"\b(state|equilibrium|ground state|excited state)\b"),
    ("measurement", "measurement", r"\b(measurement|observer|apparatus|detector)\b"),
    ("time", "time", r"\b(time|duration|simultaneity)\b"),
    ("entity", "entity", r"\b(body|bodies|object|system|substance)\b"),
    ("process", "process", r"\b(process|evolution|propagation|transformation|decay|emission|absorption)\b"),
)

# What stands between the two ends of a relation, its kind and confidence.
RELATION_PHRASES = (
    (r"\s+causes?\s+", "CAUSES", 0.85),
    (r"\s+produces?\s+", "CAUSES", 0.8),
    (r"\s+(?:consists|composed)\s+of\s+", "COMPOSED_OF", 0.85),
    (r"\s+propagates?\s+through\s+", "PROPAGATES_THROUGH", 0.9),
    (r"\s+interacts?\s+with\s+", "INTERACTS_WITH", 0.85),
    (r"\s+depends?\s+on\s+", "DEPENDS_ON", 0.8),
    (r"\s+has\s+(?:the\s+)?propert(?:y|ies)\s+(?:of\s+)?", "HAS_PROPERTY", 0.8),
    (r"\s+transforms?\s+into\s+", "TRANSFORMS_INTO", 0.85),
    (r"\s+is\s+distinct\s+from\s+", "DISTINCT_FROM", 0.85),
    (r"\s+measures?\s+", "OBSERVABLE_AS", 0.75),
    (r"\s+(?:is\s+)?located\s+in\s+", "LOCATED_IN", 0.75),
    (r"\s+carries?\s+", "CARRIES", 0.75),
    (r"\s+pervades?\s+", "PERVADES", 0.8),
)

# Cues of the base pack, for each of the 36 features.
BASE_CUES = (
    ("O01", r"underlying (reality|entity|substrate|level)"),
    ("O02", r"composed of|aggregates of|made of (more )?elementary"),
    ("O03", r"indivisible|cannot be further divided|discrete (atoms|units)"),
    ("O04", r"continuous (medium|entity|substrate|field)"),
    ("O05", r"localized manifestations|local forms appear"),
    ("O06", r"arise from lower-level|emerge from"),
    ("D01", r"configuration|distinguishable (states|configurations)"),
    ("D02", r"evolves according|change according to|transformation law"),
    ("D03", r"oscillat|periodically|cyclic"),
    ("D04", r"propagat|travels through"),
    ("D05", r"conserved|remains unchanged|invariant quantity"),
    ("D06", r"invariant under"),
    ("D07", r"reversed|inverse process|reversible"),
    ("Q01", r"only (certain|discrete) (energy )?levels|allowed (states|values)"),
    ("Q02", r"superposition|simultaneously represented|jointly represents mutually exclusive"),
    ("Q03", r"probabilities are basic|inherent probability|irreducible probability"),
    ("Q04", r"measurement interaction|outcome is produced in association with a measurement"),
    ("Q05", r"cannot both have definite|incompatible observables|non-commuting"),
    ("Q06", r"cannot be (written|represented) as independent component|non-?factoriz|nonseparab"),
    ("Q07", r"depend(s)? on (which|the) (compatible )?measurement context|contextuality"),
    ("Q08", r"discrete excitations of (the )?(underlying )?field|quanta of the field"),
    ("R01", r"local interactions|neighboring interactions"),
    ("R02", r"distant (entities|systems).*(correlat|relation)"),
    ("R03", r"not recoverable from independent part|irreducible whole"),
    ("R04", r"defined relative to|relative to a reference"),
    ("M01", r"distinguish (the )?measur|observer and (the )?observed|apparatus from the measured"),
    ("M02", r"measurement interaction alters|observation (physically )?changes|alters the system's"),
    ("M03", r"cannot know|ignorance of|unknown to us"),
    ("M04", r"no definite value is predetermined|not predetermined prior"),
    ("F01", r"throughout a spatial region|across (an )?extended|present throughout"),
    ("F02", r"different values at different locations|spatially varying"),
    ("F03", r"travels through space|propagat\w+ through"),
    ("F04", r"manifestations of the (extended )?field|arise from that distributed"),
    ("F05", r"mediated by the|mediates interactions"),
    ("F06", r"dynamical disturbance of the medium|dynamically changed states of the underlying"),
    ("F07", r"discrete excitation quanta|only discrete excitations"),
)

# Cues that deny a feature.
NEGATIVE_CUES = (
    ("Q06", r"everything is (one|interconnected)|all is one"),
    ("Q03", r"probability only reflects our ignorance"),
    ("M04", r"definite value exists but is unknown"),
)

# Cues of classical natural philosophy.
CLASSICAL_CUES = (
    ("O01", r"\b(first[- ]beginnings|primordial|underlying (nature|substance))\b"),
    ("O01", r"\bthat from which (all )?(things|beings) (arise|come|spring)\b"),
    ("O02", r"\b(atoms?|corpuscles?|seeds of things|first bodies)\b"),
    ("O02", r"\bcomposed of|made up of|aggregat\w+\b"),
    ("O03", r"\bindivisible\b|\bcannot be (cut|split|divided)\b|\bvoid and atoms\b"),
    ("O03", r"\bsmallest (bodies|parts|particles)\b"),
    ("O04", r"\b(void|vacuum|empty space)\b"),
    ("O04", r"\bcontinuous (nature|substance|medium)\b"),
    ("D02", r"\b(come into being|pass away|arise and perish|transformation)\b"),
    ("D04", r"\b(motion through|travels? through|diffuse[sd]? through)\b"),
    ("R01", r"\b(collision|blow|impact|contact) of (atoms|bodies)\b"),
    ("F01", r"\bpervade[sd]?\b|\bfills? (all )?space\b|\bextended through\b"),
    ("M03", r"\bbeyond (our )?ken\b|\bcannot (be )?perceive\b|\bhidden from (the )?senses\b"),
)

# Cues of metaphysics.
METAPHYSICAL_CUES = (
    ("O01", r"\b(brahman|atman|absolute|supreme (self|reality|being)|ultimate reality)\b"),
    ("O01", r"\bthe (one|infinite|unchanging) (reality|self|ground)\b"),
    ("O01", r"\bunderlying (self|reality|being|principle)\b"),
    ("O02", r"\b(part and whole|whole and (its )?parts|higher self|lower self)\b"),
    ("O02", r"\b(rooted above|branches downward|tree of creation)\b"),
    ("O04", r"\b(all[- ]pervad\w+|omnipresent|fills? (all|the) (space|world))\b"),
    ("O04", r"\b(ether|akasha|ākāśa|space itself)\b"),
    ("O05", r"\b(manifests?|manifestation|appears? as|phenomenal world)\b"),
    ("O05", r"\b(names? and forms?|nama[- ]rupa)\b"),
    ("D02", r"\b(birth and death|mortal and immortal|becoming|samsara)\b"),
    ("D02", r"\b(change|changing conditions|impermanent)\b"),
    ("F01", r"\b(pervad\w+|all[- ]pervad\w+|present in all)\b"),
    ("M03", r"\b(beyond (all )?human conception|ineffable|cannot be (defined|spoken))\b"),
    ("M03", r"\b(unknown|unknowable) to (the )?senses\b"),
)

# Modern physics words whose number in a translation is counted.
MODERN_LEXICON = (
    "energy", "field", "vibration", "particle", "atom", "frequency", "information", "dimension", "quantum", "wave",
    "spectrum", "force", "matter", "space-time", "spacetime",
)

# Words that are masked, and whose density is measured.
MASK_TERMS = ("atom", "particle", "wave", "field", "energy", "quantum", "vibration", "ether", "aether", "space", "force")

# Words that give a text's class away.
GIVEAWAY_TERMS = (
    "quantum", "relativity", "relativistic", "newton", "newtonian", "maxwell", "entropy", "thermodynamic", "thermodynamics",
    "photon", "electron", "hilbert", "schrödinger", "schrodinger", "spacetime", "electromagnetic", "electromagnetism",
    "einstein", "planck", "bohr",
)

# Keywords of the 17 features of the lexical proxy.
FEATURE_KEYWORDS = (
    ("O02", ("mass", "particle", "atom", "constituent", "corpuscle")),
    ("O04", ("field", "medium", "wave")),
    ("O06", ("entropy", "equilibrium", "macroscopic", "temperature", "thermal")),
    ("D01", ("force", "acceleration", "motion", "orbit", "heat flow", "heat flows")),
    ("D02", ("conserv", "first law", "energy transfer", "work and heat")),
    ("D04", ("equation", "law", "maxwell", "lagrangian")),
    ("D05", ("irreversible", "reversible", "equilibrium", "state variable")),
    ("F01", ("field",)),
    ("F02", ("electromagnetic", "electric", "magnetic", "maxwell")),
    ("F03", ("light", "radiation")),
    ("F07", ("quantized", "quantum field", "fock", "excitation")),
    ("Q01", ("operator", "eigen", "superposition", "born")),
    ("Q03", ("planck", "discrete spectra", "ħ", "hbar")),
    ("Q06", ("entangle",)),
    ("Q08", ("creation", "annihilation", "fock", "quantized field")),
    ("R01", ("field", "mediate", "interaction")),
    ("M03", ("statistical", "entropy", "ignorance", "macroscopic")),
)

# Vocabulary of the classes next to each class.
NEIGHBOUR_TERMS = (
    ("newtonian", ("entropy", "electromagnetic", "quantum", "relativity", "spacetime")),
    ("thermodynamics", ("quantum", "photon", "relativity", "maxwell equation")),
    ("classical_em", ("photon", "quantum", "relativity", "entropy")),
    ("relativity", ("newton", "quantum", "photon", "entropy")),
    ("quantum_mechanics", ("classical limit", "maxwell", "newtonian", "thermodynamic")),
    ("quantum_field_theory", ("classical electromagnetism", "maxwell", "newton")),
    ("atomistic_corpuscular", ("quantum", "relativity", "electromagnetic field")),
)

# Keywords of a page's name that tell its class, in the order in which they are tried; "^" begins the name.
PAGE_RULES = (
    ("quantum_field_theory", ("^11-", "particle-physics", "quark", "standard-model", "gauge", "boson")),
    ("relativity", ("relativ", "special-relativity", "general-relativity")),
    ("quantum_field_theory", ("quantum-field", "standard-model")),
    ("quantum_mechanics", (
        "quantum", "photoelectric", "bohr", "wave-function", "schrodinger", "heisenberg", "spin", "uncertainty",
        "wave-particle", "tunneling", "harmonic-oscillator",
    )),
    ("thermodynamics", ("thermo", "entropy", "heat", "kinetic-theory", "ideal-gas")),
    ("classical_em", (
        "electric", "magnetic", "maxwell", "circuit", "capacit", "induct", "electromagnetic", "optics", "light", "wave",
    )),
    ("atomistic_corpuscular", ("atom", "nucleus", "radioactiv", "rutherford", "nuclear")),
)

# The class of a book's other pages, by a part of its name, and of the rest.
BOOK_RULES = (("quantum_mechanics", ("volume-3",)), ("classical_em", ("volume-2",)))
OTHER_PAGES = "newtonian"

# The names of the robustness tests.
ROBUSTNESS_TESTS = (
    "A_remove_unity_concepts", "B_remove_vibration_concepts", "C_remove_atomism", "D_remove_prana", "E_remove_akasa", "F_remove_brahman", "G_remove_sakti_spanda",
    "H_older_translations_only", "I_literal_translations_only", "J_mask_physics_vocab", "K_human_annotations_only", "L_high_confidence_only", "N_no_embeddings", "S_alternative_metrics",
)
