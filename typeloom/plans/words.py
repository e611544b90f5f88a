"""Frequent English words, by which free text is told from other strings."""

COMMON = frozenset(
    """
    a about after again all also always am an and any are around as ask at away back be because been before being best better
    between big both but by call came can come could day did do does done down each even ever every few find first for found
    from get give go going good got great had has have he help her here him his home house how i if in into is it its just
    keep know last let life like little long look made make man many may me more most much must my name need never new next
    no not nothing now of off old on once one only or other our out over own part people place put right said same saw say
    see she should since so some such take tell than that the their them then there these they thing think this those time
    to too two under until up us use very want was way we well went were what when where which while who why will with work
    would year you your
    """.split()
)
