"""Physical-plan helpers: checked broadcasts, exact quantiles, bucketed running totals."""
