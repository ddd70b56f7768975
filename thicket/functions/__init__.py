"""Column functions and the small text helpers behind them."""
