"""The flat query grammar, its plan on a DataFrame, the repair ladder and the question compiler."""
