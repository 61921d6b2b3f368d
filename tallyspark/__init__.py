"""Evidence admission, exact reconciliation and search over DataFrames, at any scale."""
