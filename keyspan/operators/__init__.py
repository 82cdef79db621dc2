"""Relations: keyed streams, maps, sets, dense arrays, trees and graphs."""
