LAST = (1 << 63) - 1


def order(doc_id):
    """A null identifier counts as the largest."""
    return LAST if doc_id is None else doc_id
