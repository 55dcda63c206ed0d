"""Column functions and the line scanners behind them."""
