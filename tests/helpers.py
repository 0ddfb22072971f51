"""Comparing a Spark result with an oracle's, whatever the order of rows and columns."""


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(9)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    g, w = canonical(got), canonical(want)
    assert g.equals(w), (g[g.ne(w).any(axis=1)].head(), w[g.ne(w).any(axis=1)].head())
