"""DataFrame operators over observations, pairs, groups, trees and site features."""
