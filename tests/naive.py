"""A naive evaluator of positive and stratified programs, written apart from the engine: the oracle of random tests."""


def evaluate(rules, facts, strata):
    """rules: (head, positive atoms, negative atoms), atoms are (name, terms); variables are upper-case strings."""
    known = {k: set(v) for k, v in facts.items()}
    for level in strata:
        again = True
        while again:
            again = False
            for (name, terms), positive, negative in rules:
                if name not in level:
                    continue
                for env in matches(positive, known, {}):
                    if any(tuple(env.get(t, t) for t in ts) in known.get(n, ()) for n, ts in negative):
                        continue
                    row = tuple(env.get(t, t) for t in terms)
                    if row not in known.setdefault(name, set()):
                        known[name].add(row)
                        again = True
    return known


def matches(atoms, known, env):
    if not atoms:
        yield env
        return
    (name, terms), *rest = atoms
    for row in list(known.get(name, ())):
        new = dict(env)
        for t, v in zip(terms, row, strict=True):
            if isinstance(t, str):
                if new.setdefault(t, v) != v:
                    break
            elif t != v:
                break
        else:
            yield from matches(rest, known, new)
